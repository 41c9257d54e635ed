"""Small tables made by hand for reports and single-candidate links."""

from __future__ import annotations

from marketlens.operators import reports as R


def test_first_tier_with_one_candidate(spark):
    rows = [(1, 5, 2, 0.85), (1, 6, 2, 0.85), (1, 7, 3, 0.9), (2, 5, 4, 0.6), (2, 5, 4, 0.6), (3, 1, 2, 0.85), (3, 2, 2, 0.85), (4, 8, 3, 0.9), (4, 9, 2, 0.85)]
    got = {r.id: (r.other, r.tier) for r in R.first_single(spark.createDataFrame(rows, "id long, other long, tier int, confidence double")).collect()}
    assert got == {1: (7, 3), 2: (5, 4), 4: (9, 2)}


def test_representative_act(spark):
    rows = [(1, 10, False, "2024-05-01", 5.0), (1, 11, True, "2023-01-01", 7.0), (1, 12, True, "2023-01-01", 8.0), (2, 20, None, None, None), (2, 21, None, "2020-01-01", 1.0)]
    acts = spark.createDataFrame(rows, "process_id long, act_id long, notice boolean, published string, amount double").selectExpr("*", "published as deadline")
    scores = spark.createDataFrame([(1, 80.0, None)], "process_id long, score double, confidence double")
    got = {r.process_id: (r.act_id, r.budget, r.acts, r.score, r.confidence) for r in R.bid_reports(acts, scores).collect()}
    assert got == {1: (11, 7.0, 3, 80.0, 35.0), 2: (21, 1.0, 2, 50.0, 35.0)}
