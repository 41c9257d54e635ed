"""Queries of the operators on tokens' merges and on vectors: 11, 12, 13."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe_codec, vector_codes, whitening
from marketlens.llm.common import cut, table
from marketlens.llm.q_text import tokenizer_path


def op11_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes ``docs`` (doc_id, text) and digests the outcome."""
    coded = bpe_codec.encode(docs.select("doc_id", "text"), path, packed=True).select("doc_id", "ids")
    both = bpe_codec.decode(coded, path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_digest(table(spark, sf_dir, "documents", "doc_id", "text"), str(tokenizer_path("word_bpe_49k.json")))


def op12_digest(vectors: DataFrame) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding, label). The sums by label are made from codes that are written once; Spark
    broadcasts them while labels are few and splits a hot label's rows beyond that."""
    coded, books = vector_codes.compress(vectors.select("vec_id", "label", "embedding"))
    coded = cut(coded)
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left")
    return out.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_digest(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def op13_digest(vectors: DataFrame, most: int = 16) -> DataFrame:
    """One row for each vector of ``vectors`` (vec_id, embedding) and component, counted from 1."""
    white, w = whitening.whiten(vectors.select("vec_id", "embedding"), most=most)
    n, error = (w.n, w.identity_error) if w else (0, 0.0)
    explained = F.array(*(F.lit(float(v)) for v in (w.explained if w else [])))
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_digest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op11_bpe": op11_bpe, "op12_vector_codes": op12_vector_codes, "op13_whitening": op13_whitening}


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds of compression as a chain of tables; products of these integers are exact in doubles."""
    head = f"""
with kept as materialized (
  select row_number() over (order by vec_id nulls last, x) - 1 as rid, vec_id, label, x from (
    select vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::double)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)),
cells as materialized (
  select rid, p::int as p, list_slice(x, (p * len(x) // {parts} + 1)::bigint, ((p + 1) * len(x) // {parts})::bigint) as part from kept, range({parts}) r(p)),
b0 as materialized (select p, rid::int as e, part as c from cells where rid < {entries})"""
    near = """
a{k} as materialized (
  select s.rid, s.p, s.part, min({{'d': list_inner_product(b.c, b.c) - 2 * list_inner_product(s.part, b.c), 'e': b.e}}) as best
  from cells s join b{k} b using (p) group by s.rid, s.p, s.part)"""
    means = """
m{k} as materialized (
  select p, e, list(v order by i) as c from (
    select p, e, i, floor(sum(v) / count(*)) as v from (
      select p, best.e as e, unnest(part) as v, generate_subscripts(part, 1) as i from a{k}) group by p, e, i) group by p, e),
b{j} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from b{k} b left join m{k} m using (p, e))"""
    chain = [head] + [text.format(k=k, j=k + 1) for k in range(rounds) for text in (near, means)] + [near.format(k=rounds)]
    tail = f"""
, coded as materialized (
  select rid, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' order by p) as code, cast(sum(best.d + list_inner_product(part, part)) as bigint) as error
  from a{rounds} group by rid),
digest as (
  select sha256(string_agg(v::bigint::varchar, ',' order by p, e, i)) as codebooks_sha256 from (
    select p, e, unnest(c) as v, generate_subscripts(c, 1) as i from b{rounds}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (rid) cross join digest"""
    return ",".join(chain) + tail


ORACLES: dict[str, str] = {"op12_vector_codes": _op12_sql()}
