"""Pairs of many equal entities: what a pair costs, and odd rows against SQL."""

from __future__ import annotations

import pytest

from marketlens import catalogue
from marketlens.operators import linkage
from tests.compare import same

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    rows = [(k, "hot bolt", "Brand#1", "LARGE", k % 3 * 30, 900.0 + k % 2) for k in range(40)]
    rows += [(5, "hot bolts", "Brand#1", "LARGE", 7, 1000.5), (None, "hot bolt", "Brand#1", "LARGE", 1, 1.0), (41, "hot bolt", "Brand#1", None, 1, 1.0), (42, None, "Brand#1", "LARGE", 1, 1.0)]
    rows += [(43, "", "", "LARGE", 1, 1.0), (44, "HOT  bolt", "Brand#1", "LARGE", None, None), (45, "cold ring", "Brand#9", "SMALL", 1, 1.0), (46, "cold ring", "Brand#9", "SMALL", 50, 2.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size long, p_retailprice double").write.parquet(f"{top}/part.parquet")
    for t in "region nation customer supplier orders lineitem events documents embeddings pages benchmark labels conversations".split():
        (top / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["entity_candidates", "entity_scores"])
def test_pairs_are_made_last_and_are_those_of_sql(spark, odd, name):
    df = catalogue.queries()[name](spark, odd)
    # what is above the pairs of entities: nothing is joined, shuffled, rounded or weighed there
    above = plan(df).split("Generate explode(ids")[0]
    assert "Generate explode(ids" in plan(df) and not any(x in above for x in ("Join", "Exchange", "round("))
    if name == "entity_scores":
        same(df, catalogue.oracle_sql()[name], odd)


def test_like_sets_of_a_block_meet_in_many_tasks(spark, odd):
    """Few bytes can stand for much work, so tasks must not be merged by their size."""
    names = spark.read.parquet(f"{odd}/part.parquet").selectExpr("p_partkey as id", "p_type", "concat_ws(' ', p_name, p_brand) as name")
    assert plan(linkage.entity_candidates(names, 0.58, ["p_type"])).count("REPARTITION_BY_NUM") >= 2
