"""What several operators share: checkpoints, table reading, batch sizes, splits by document number."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.spans import SHORT, bounded
from marketlens.session import CLEANUP as _CLEANUP
from marketlens.session import cut as cut

#: Rows an Arrow batch may hold: whole texts are long, so batches are kept short.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A test table, cut down to ``cols`` so that the scan reads no other column."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, as their Python may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def short_batches(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """Readies the session for Python tasks: they get this package, and Arrow batches short enough for long texts,
    by rows and by bytes (256 of the longest texts would be some 30 MB, several times in a task's memory)."""
    ship(df.sparkSession)
    conf = bounded(df).sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:  # set once; a session that asks for shorter ones keeps them
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        conf.set(SHORT, str(rows))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors and the driver see.

    Only a session on one machine, as in tests, gets a folder of its own where none is named; elsewhere that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _folders:
        _folders[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _folders[sc.applicationId]


_folders: dict[str, str] = {}


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that ``df`` doesn't have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while f"_{name}{k or ''}".lower() in taken:
            k += 1
        taken.add(f"_{name}{k or ''}".lower())
        out.append(f"_{name}{k or ''}")
    return out


def hold(df: DataFrame) -> DataFrame:
    """Keeps what is read several times in memory, else on disk; what a lost executor held is made anew from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str = "doc_id", of: int = 5) -> Column:
    """crc32(doc_id as text) mod ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(of)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def chunks(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(first, last+1) of runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
