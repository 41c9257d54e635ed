"""Sources and sinks: raw store, JSON envelopes and chains, XML, CSV with drifting headers, GeoJSON, archives, exports, upserts."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Magic numbers of the file types that the sniffer knows, as hex.
MAGIC = {"application/pdf": "25504446", "application/zip": "504B0304", "image/png": "89504E47", "image/jpeg": "FFD8FF", "application/gzip": "1F8B"}


def put_raw(payloads: DataFrame, path: str) -> DataFrame:
    """Appends payloads (source, resource, ingestion_date, payload) to an immutable store, addressed by content. What the
    store already holds is left out, so a second run writes nothing. Returns what was new."""
    spark = payloads.sparkSession
    new = payloads.withColumn("content_sha256", F.sha2(F.col("payload").cast("binary"), 256)).dropDuplicates(["source", "resource", "content_sha256"])
    try:
        seen = spark.read.parquet(path).select("source", "resource", "content_sha256")
        new = new.join(seen, ["source", "resource", "content_sha256"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    new.write.mode("append").partitionBy("source", "resource", "ingestion_date").parquet(path)
    return new


def sniff(content: Column) -> Column:
    """MIME type by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), F.lit(""))
    for kind, magic in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    return out.when(F.decode(F.substring(content, 1, 64), "UTF-8").rlike(r"^\s*[\[{]"), "application/json").when(F.decode(F.substring(content, 1, 64), "UTF-8").rlike(r"^\s*<"), "application/xml").otherwise("application/octet-stream")


def first_of(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first of some alternative columns that is there and not empty, cast where it can be."""
    low = {c.lower(): c for c in df.columns}
    have = [F.nullif(F.trim(F.col(f"`{low[n.lower()]}`")), F.lit("")) for n in names if n.lower() in low]
    return (F.coalesce(*have) if have else F.lit(None)).try_cast(kind)


def read_csv(spark: SparkSession, path: str, columns: dict[str, tuple[Sequence[str], str]], required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """A CSV file under one of several headers: column to (candidate headers, type). Rows without a required value are skipped."""
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    out = raw.select(*(first_of(raw, names, kind).alias(c) for c, (names, kind) in columns.items()))
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out


def fingerprint(df: DataFrame, kind: str) -> str:
    """SHA-256 of a file's format and sorted columns."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"columns": sorted(df.columns), "format": kind}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def read_envelope(spark: SparkSession, path: str, record: str, key: str = "data") -> DataFrame:
    """Records of paged JSON envelopes {key: [...]}; pages that don't parse are kept apart in _corrupt, and harm no other."""
    raw = spark.read.text(path, wholetext=True)
    page = F.from_json("value", f"{key} array<{record}>, isLastPage boolean, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.select(page.alias("p")).select(F.explode_outer(f"p.{key}").alias("r"), F.col("p._corrupt").alias("_corrupt")).select("r.*", "_corrupt")


BUCKETS = ("requests", "approvedRequests", "notices", "auctions", "contracts", "payments")


def read_chain(df: DataFrame, column: str = "value") -> DataFrame:
    """Lifecycle chains {bucket: [identifier...]} as rows (bucket, nth, identifier, change): a star behind an identifier marks
    a modification, two a cancellation."""
    j = F.from_json(column, ", ".join(f"{b} array<string>" for b in BUCKETS))
    rows = df.withColumn("_j", j).select("*", F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.coalesce(F.col("_j")[b], F.array().cast("array<string>")).alias("ids")) for b in BUCKETS))).alias("_b"))
    rows = rows.select(*df.columns, F.col("_b.bucket").alias("bucket"), F.posexplode("_b.ids").alias("nth", "raw"))
    change = F.when(F.col("raw").endswith("**"), "CANCELLATION").when(F.col("raw").endswith("*"), "MODIFICATION")
    return rows.select(*df.columns, "bucket", "nth", F.upper(F.trim(F.rtrim(F.col("raw"), F.lit("*")))).alias("identifier"), change.alias("change"))


#: Edges of a chain as (from bucket, to bucket, type).
CHAIN_EDGES = (("approvedRequests", "requests", "APPROVES"), ("requests", "notices", "ANNOUNCES"), ("notices", "auctions", "AWARDS"), ("auctions", "contracts", "EXECUTES"), ("contracts", "payments", "PAYS"))


def chain_edges(entries: DataFrame, chain: str) -> DataFrame:
    """Typed edges of chains: buckets that follow each other are joined within a chain; a starred entry points to the entry
    before it in its bucket. Awards and payments point back, from the later to the earlier act."""
    steps = entries.sparkSession.createDataFrame(CHAIN_EDGES, "a string, b string, link_type string")
    x = entries.where("change is null").select(F.col(chain), F.col("bucket").alias("a"), F.col("identifier").alias("x"))
    y = entries.where("change is null").select(F.col(chain), F.col("bucket").alias("b"), F.col("identifier").alias("y"))
    plain = x.join(F.broadcast(steps), "a").join(y, [chain, "b"])
    back = F.col("link_type").isin("AWARDS", "PAYS")
    plain = plain.select(chain, F.when(back, F.col("y")).otherwise(F.col("x")).alias("from_id"), F.when(back, F.col("x")).otherwise(F.col("y")).alias("to_id"), "link_type")
    before = F.lag("identifier").over(Window.partitionBy(chain, "bucket").orderBy("nth"))
    starred = entries.withColumn("p", before).where("change is not null and p is not null").select(chain, F.col("identifier").alias("from_id"), F.col("p").alias("to_id"), F.when(F.col("change") == "CANCELLATION", "CANCELS").otherwise("AMENDS").alias("link_type"))
    return plain.unionByName(starred)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features (properties, rings, n_points, lon, lat): polygons and multipolygons as arrays of rings, with the mean of the
    outer points; other geometries are an error in column ``problem``."""
    raw = spark.read.text(path, wholetext=True)
    f = F.from_json("value", "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>")
    one = raw.select(F.explode(f["features"]).alias("f")).select("f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    poly, multi = F.from_json("c", "array<array<array<double>>>"), F.from_json("c", "array<array<array<array<double>>>>")
    rings = F.when(F.col("type") == "Polygon", poly).when(F.col("type") == "MultiPolygon", F.flatten(multi))
    out = one.withColumn("rings", rings).withColumn("points", F.flatten("rings"))
    mean = lambda i: F.aggregate("points", F.lit(0.0), lambda a, p: a + p[i], lambda a: a / F.size("points"))
    return out.select("properties", "rings", F.size("points").alias("n_points"), mean(0).alias("lon"), mean(1).alias("lat"), F.when(F.col("rings").isNull(), F.concat(F.lit("unsupported geometry "), F.col("type"))).alias("problem"))


def read_zipped_lines(spark: SparkSession, path: str, member: str = ".txt") -> DataFrame:
    """Lines of the members of zip archives, a task an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith(member):
                            with z.open(m) as f:
                                lines = io.TextIOWrapper(f, "utf-8").read().splitlines()
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([m] * len(lines)), pa.array(lines, pa.string())], names=["path", "member", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, line string")


def gazetteer(lines: DataFrame) -> DataFrame:
    """Places of a tab-separated gazetteer: classes A and P with 19 fields at least."""
    f = F.split("line", "\t")
    rows = lines.where(F.size(f) >= 19).select(f[0].try_cast("long").alias("place_id"), f[1].alias("name"), F.split(f[3], ",").alias("aliases"), f[4].try_cast("double").alias("lat"), f[5].try_cast("double").alias("lon"), f[6].alias("class"), f[7].alias("code"), f[14].try_cast("long").alias("population"))
    return rows.where(F.col("class").isin("A", "P") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of both, the latest for each key; of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values that begin like a formula are escaped."""
    safe = {c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c, t in df.dtypes if t == "string"}
    df.withColumns(safe).write.mode("overwrite").option("header", True).csv(path)


def publish(df: DataFrame, top: str, name: str) -> str:
    """Writes a versioned copy, compares counts, and only then moves the pointer file; readers see the old or the new one."""
    spark = df.sparkSession
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    wrote, want = spark.read.parquet(path).count(), df.count()
    if wrote != want:
        raise RuntimeError(f"{name}: {wrote} rows written, {want} expected")
    spark.createDataFrame([(name, path)], "name string, path string").coalesce(1).write.mode("overwrite").parquet(f"{top}/{name}.current")
    return path


def published(spark: SparkSession, top: str, name: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{top}/{name}.current").first().path)
