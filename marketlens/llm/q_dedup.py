"""Queries of the operators that compare rows with each other: 2, 3, 4, 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bwt_dedup, line_dedup, order_minhash, projection_dedup
from marketlens.llm.common import table


def op2_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many of its lines aren't blank, how many of them stay, and which lines (counted from 0) go.
    Documents without such lines have 0, 0 and no line that goes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    drops = line_dedup.duplicate_lines(docs).where("not kept").groupBy(F.col("doc").alias("id"), F.col("body").alias("b")).agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"\S"))).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), n.alias("n_lines"))
    out = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("b")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def op4_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the least doc_id of its class of near copies, and whether it is the one that stays."""
    out = order_minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "class_id", "kept")


QUERIES = {"op2_bwt_dedup": op2_bwt_dedup, "op4_projection_dedup": op4_projection_dedup, "op6_order_minhash": op6_order_minhash, "op3_line_dedup": op3_line_dedup}
ORACLES: dict[str, str] = {}
