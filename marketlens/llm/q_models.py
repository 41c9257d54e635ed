"""Queries of the operators that learn from the corpus: 5 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import context_mixing, toxicity
from marketlens.llm.common import remainder, table


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context_mixing.score(table(spark, sf_dir, "documents", "doc_id", "text"), remainder() != 1)
    bits = -F.col("score") * F.lit(3.321928094887362) / (F.col("n_bytes") + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(remainder() != 0)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model, keep_text=False)
    return out.select("doc_id", (remainder() == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_context_mixing": op5_context_mixing, "op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
