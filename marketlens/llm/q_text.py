"""Queries of the operators that read each text alone: 1, 7, 8, 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm import chat_format, decontaminate, license_scan, sentencepiece_codec
from marketlens.llm.common import table

#: Code points in a streamed delta of the derived log.
DELTA = 512


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_digest(docs: DataFrame) -> DataFrame:
    """Scans ``docs`` (doc_id, text) for licences. Base labels stand beside the method's own."""
    out = license_scan.scan(docs.select("doc_id", "text")).drop("text")
    base = F.array_sort(F.map_keys(F.map_filter("base_counts", lambda _, n: n > 0)))
    n_base = F.aggregate(F.map_values("base_counts"), F.lit(0).cast("long"), lambda a, n: a + n)
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.col("base_first").alias("first_word"), F.col("base_last").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "labels")), ",").alias("labels"),
        F.greatest("score", F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes and decodes ``docs`` (doc_id, text) and digests the outcome."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "text"), model_path).select("doc_id", "ids")
    both = sentencepiece_codec.decode(coded, model_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_digest(table(spark, sf_dir, "documents", "doc_id", "text"), str(tokenizer_path()))


def conversation_log(turns: DataFrame) -> DataFrame:
    """An event log from rows by turn: each row opens a turn by an empty message and streams its text as deltas."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("turn"))
    n = F.ceil(F.char_length("text") / DELTA).cast("int")
    opened = F.array(F.struct(F.lit(0).alias("i"), F.lit("message").alias("kind"), F.lit("").alias("text")))
    deltas = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.lit("delta").alias("kind"), F.substring(F.col("text"), (i - 1) * DELTA + 1, F.lit(DELTA)).alias("text")))
    e = t.select("conv_id", "turn", "role", F.explode(F.when(n > 0, F.concat(opened, deltas)).otherwise(opened)).alias("e"))
    return e.select("conv_id", (F.col("turn") * F.lit(1 << 32) + F.col("e.i")).alias("seq"), "turn", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def op8_digest(turns: DataFrame) -> DataFrame:
    out = chat_format.parse(chat_format.render(chat_format.fold(conversation_log(turns))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return op8_digest(turns.unionByName(extra))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it leaks a benchmark item, and which."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.size("leaked_items").cast("long").alias("n_items"), F.col("leaked_items").alias("item_ids"), F.col("leaked_share").alias("share"))


QUERIES = {"op9_decontaminate": op9_decontaminate, "op1_license_scan": op1_license_scan, "op7_sentencepiece": op7_sentencepiece, "op8_chat_format": op8_chat_format}

_OP8_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, replace(replace(role, '\', '\\'), '<|', '<\|') as er, replace(replace(text, '\', '\\'), '<|', '<\|') as et from said)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(er) + 10 + length(et) + 10) as bigint) as formatted_chars
from escaped group by conv_id
"""
ORACLES: dict[str, str] = {"op8_chat_format": _OP8_SQL}
