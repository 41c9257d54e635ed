"""What queries shuffle and read again, as plans tell it, and rows that shorter plans must not lose."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from marketlens.lens import Lens
from marketlens.operators import bundle, chain, enrichment, profiles, search

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_participation_facts_take_one_shuffle_and_keep_lines_without_an_act(spark, tmp_path):
    assert plan(profiles.participation_facts(spark, SF)).count("Exchange hashpartitioning") == 1
    day = datetime.datetime(2001, 1, 1)
    rows = [(a, 1, s, k, 1.0, 1.0, 0.0, "A", "F", day) for k, (a, s) in enumerate([(None, 1), (None, 2), (None, 3), (None, 4), (7, 1), (7, 1), (7, 2), (7, 3), (7, None), (8, 5)])]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.role, str(r.act_id), str(r.party)) for r in profiles.participation_facts(spark, str(tmp_path)).collect())
    members = [("CONSORTIUM_MEMBER", "7", p) for p in ("None", "S1", "S2", "S3")]
    winners = [("WINNER", "7", p) for p in ("None", "S1", "S2", "S3")] + [("WINNER", "8", "S5")] + [("WINNER", "None", f"S{k}") for k in range(1, 5)]
    assert got == sorted(members + winners)


def test_keyword_terms_shuffle_texts_and_not_words(spark):
    assert plan(enrichment.keyword_terms_query(spark, SF)).count("Exchange hashpartitioning") == 1


def test_bm25_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "The the, a THE  cat"), (1, "the cat sat on it"), (2, "other"), (3, ""), (4, None), (5, "  the\tthe.the the"), (6, "ΆΛΦΑ the άλφα the")], "doc_id long, text string")
    best = search.bm25(docs, ("the", "cat", "αλφα", "a b", "", "the"))
    assert plan(best).count("regexp_replace") == 0  # what is stored has no texts any more
    # as by lists of words, which were made twice
    words = {1: [["the", "the", "a", "the", "cat"], ["the", "cat", "sat", "on", "it"]], 2: [["other"]], 3: [[]], 5: [["the"] * 4], 6: [["αλφα", "the", "αλφα", "the"]]}
    rows = [(d, ws) for d, each in words.items() for ws in each]
    mean, tf = sum(len(ws) for _, ws in rows) / len(rows), {}
    for d, ws in rows:
        for w in {"the", "cat", "αλφα"} & set(ws):
            tf[d, len(ws), w] = tf.get((d, len(ws), w), 0) + ws.count(w)
    import math

    want = {}
    for (d, n, w), k in tf.items():
        df = sum(x[2] == w for x in tf)
        want[d] = want.get(d, 0) + math.log(1 + (7 - df + 0.5) / (df + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * n / mean))
    assert {r.doc_id: r.score for r in best.collect()} == {d: round(x, 6) for d, x in want.items()}


def test_key_sentences_cut_each_text_once(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    before = spark.sparkContext.accumulator(0)
    counted = d.where(F.udf(lambda t: before.add(1) or True, "boolean").asNondeterministic()("text"))
    assert bundle.key_sentences(counted, "source", "doc_id").count() > 0
    assert before.value <= 2 * d.count()  # to find the best, and to get the documents of these; five times before


def test_typed_acts_tell_repeats_apart_before_they_are_texts(spark):
    acts = chain.typed_acts(Lens(spark, SF))
    assert "hashpartitioning(l_orderkey" in plan(acts) and "hashpartitioning(act_id" not in plan(acts)
    paid = acts.where("act_type = 'PAYMENT'")
    assert sorted(map(str, paid.collect())) == sorted(map(str, chain.typed_acts(Lens(spark, SF), paid_only=True).collect()))
