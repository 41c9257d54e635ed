"""Likeness of lists of texts against all pairs, and what decisions' search shuffles."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from marketlens.functions import likeness, spans
from marketlens.llm import common
from marketlens.operators import decisions

ROWS = "key string, word string, xs array<struct<text:string,words:array<string>,id:int>>, ys array<struct<text:string,words:array<string>,id:int>>"


def test_lists_give_the_pairs_that_all_pairs_give(spark):
    random.seed(5)
    text = lambda n: "".join(random.choice("ABCDE ") for _ in range(n))
    side = lambda w, k: [(text(random.choice([0, 1, 9, 30, 63, 64, 65, 300])), [w, random.choice([v for v in "pqr" if v != w])], i) for i in range(k)]
    rows = [(key, w, side(w, 40), side(w, 30)) for key in "ab" for w in "pqr"]
    want = {}
    for key, word, xs, ys in rows:
        for x in xs:
            for y in ys:
                r = SequenceMatcher(None, x[0], y[0]).ratio()
                if x[0] and y[0] and r >= 0.5 and min({*x[1]} & {*y[1]}) == word:  # empty texts are like nothing
                    want[key, word, x[2], y[2]] = r
    df = spark.createDataFrame(rows, ROWS).select(F.struct("key", "word").alias("key"), "word", "xs", "ys")
    got = {(*r.key, r.x.id, r.y.id): r.like for r in likeness.like_lists(df, 0.5).collect()}
    assert got == want and len(want) > 50
    two = {}
    for key, word, _, y in want:
        two[key, word, y] = min(two.get((key, word, y), 0) + 1, 2)
    some = {}
    for r in likeness.like_lists(df, 0.5, enough=2).collect():
        assert want[*r.key, r.x.id, r.y.id] == r.like
        some[*r.key, r.y.id] = some.get((*r.key, r.y.id), 0) + 1
    assert some == two


def test_search_makes_no_rows_of_pairs_that_are_not_like(spark):
    acts = spark.range(0, 60, 1, 1).select(F.col("id").alias("act_id"), F.lit("org one").alias("organisation"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" works")).alias("title"))
    some = acts.select((-F.col("act_id")).alias("decision_id"), "organisation", F.concat("title", F.lit(" x")).alias("title"))
    out = decisions.by_search(acts, some)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    titles = {r.act_id: r.title.upper() for r in acts.collect()}
    want = {}
    for a, t in titles.items():
        like = [d for d, u in titles.items() if SequenceMatcher(None, u + " X", t).ratio() >= 0.5]
        if len(like) == 1:
            want[a] = -like[0]
    assert {r.act_id: r.decision_id for r in out.collect()} == want and want


def test_batches_of_short_texts_are_many_rows_after_a_step_with_long_ones(spark):
    """The other order of steps in one session gave batches of 256."""
    common.short_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.ARROW_ROWS)
    spans.bounded(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(spans.BATCH_ROWS)
    common.short_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spans.bounded(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(spans.BATCH_ROWS))
