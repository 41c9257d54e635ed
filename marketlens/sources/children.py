"""Child rows that a new version of their parent replaces, published by one switch.

A state is two tables, written together: the version that each parent is at, and the child rows. A batch brings newer
versions of some parents with all their child rows. Rows of parents that it doesn't touch stay, rows of touched ones go,
but for those that later work has added (``kept``, say places found by enrichment), which stay until that work replaces
them itself. Older versions that come late change nothing, and the same batch again gives the same state.

Writers put both tables into fresh folders and then append one small file that names them, so readers see the state before
or after. A write that fails before that leaves folders that nothing points to. Touched parents are those of one batch:
Spark broadcasts them when they are few, and else joins by parent, whose rows lie apart.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def point(spark: SparkSession, pointer: str, paths: dict[str, str]) -> None:
    """Appends the row that makes ``paths`` (name to folder) the current state."""
    now = _current(spark, pointer)
    row = [((now["seq"] if now else 0) + 1, uuid.uuid4().hex, paths)]
    spark.createDataFrame(row, "seq long, id string, paths map<string,string>").coalesce(1).write.mode("append").parquet(pointer)


def _current(spark: SparkSession, pointer: str):
    try:
        return spark.read.parquet(pointer).orderBy(F.desc("seq"), F.desc("id")).first()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read(spark: SparkSession, top: str, name: str) -> DataFrame | None:
    """The child rows of the current state; None before the first one."""
    now = _current(spark, f"{top}/{name}.pointer")
    return spark.read.parquet(now["paths"]["rows"]) if now else None


def replace(spark: SparkSession, top: str, name: str, parents: DataFrame, rows: DataFrame, parent: str, version: str, kept: Column | None = None) -> DataFrame:
    """Takes in a batch: ``parents`` (parent, version), also those without child rows, and ``rows`` (parent, version, ...).

    Of several versions of a parent in a batch the highest counts; of equal rows of a version one stays; rows whose parent is
    null, or whose version the batch doesn't announce, are left out. Returns the rows of the new state, as written.
    """
    pointer = f"{top}/{name}.pointer"
    now = _current(spark, pointer)
    latest = parents.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.max(version).alias(version))
    if now:
        at = spark.read.parquet(now["paths"]["parents"])
        before = at.select(F.col(parent), F.col(version).alias("_before"))
        latest = latest.join(before, parent, "left").where(F.col("_before").isNull() | (F.col(version) >= F.col("_before"))).select(parent, version)
        states = at.join(latest, parent, "left_anti").unionByName(latest)
    else:
        states = latest
    fresh = rows.join(latest, [parent, version], "left_semi").select(*rows.columns).dropDuplicates()
    if now:
        old = spark.read.parquet(now["paths"]["rows"])
        stay = old.join(latest, parent, "left_anti")
        if kept is not None:
            stay = stay.unionByName(old.where(kept).join(latest, parent, "left_semi"))
        fresh = stay.unionByName(fresh)
    folder = f"{top}/{name}-{uuid.uuid4().hex}"
    states.write.parquet(f"{folder}/parents")
    fresh.write.parquet(f"{folder}/rows")
    point(spark, pointer, {"parents": f"{folder}/parents", "rows": f"{folder}/rows"})
    return spark.read.parquet(f"{folder}/rows")


def differences(before: DataFrame, after: DataFrame, parent: str, item: str) -> DataFrame:
    """(parent, added, removed): items that a parent has now and had not, and the other way; parents without change are left
    out. Items are compared as sets."""
    both = before.select(parent, item, F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(parent, item, F.lit(0), F.lit(1)))
    side = both.groupBy(parent, item).agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    out = side.groupBy(parent).agg(F.array_sort(F.collect_set(F.when(F.col("a") == 1, F.col(item)))).alias("added"), F.array_sort(F.collect_set(F.when(F.col("b") == 1, F.col(item)))).alias("removed"))
    return out


def primary(rows: DataFrame, parent: str, order: str, flag: str = "is_primary") -> DataFrame:
    """Marks the first child row of each parent."""
    return rows.withColumn(flag, F.row_number().over(Window.partitionBy(parent).orderBy(F.asc_nulls_last(order))) == 1)
