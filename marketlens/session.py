"""The Spark session that tests, bench and the command line use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "marketlens", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with UTC, ANSI SQL and adaptive execution; ``conf`` (dots written as __) overrides."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A session on one machine, as in tests, gets a folder of its
    own where none is named; elsewhere that is an error, as executors would not see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _own[sc.applicationId]


_own: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder of checkpoints to the shared one, if none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: Lets the shuffle files of an execution go when it ends; read when a DataFrame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder. What was shuffled for it goes from the disks at once, not when
    the driver happens to collect its garbage."""
    checkpoint_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a new DataFrame, as it takes the setting with it
    finally:
        conf.set(CLEANUP, before)
