"""What queries leave on disk while they go on."""

from __future__ import annotations

import time

import pytest

from marketlens import catalogue

SF = "/root/testdata/sf0.001"


def shuffled(spark) -> set[str]:
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("name", ["entity_match_candidates", "entity_match_scores"])
def test_checkpoints_of_entities_leave_no_shuffle_files(spark, name):
    before = shuffled(spark)
    df = catalogue.queries()[name](spark, SF)
    deadline = time.time() + 15
    while shuffled(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert df.columns


def test_indicators_are_worked_out_one_after_the_other(spark):
    """Their union has nothing to shuffle any more, and no shuffle files of any are left."""
    before = shuffled(spark)
    df = catalogue.queries()["risk_all"](spark, SF)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    deadline = time.time() + 15
    while shuffled(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled(spark) - before


def test_parts_of_a_process_meet_before_lists_are_begun(spark):
    """Lists that are begun before the shuffle are of one item each: they are sorted, written and merged for nothing."""
    plan = catalogue.queries()["process_360_view"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    begun = plan[plan.index("partial_collect_list") :]
    assert "REPARTITION_BY_COL" in begun.split("Exchange", 2)[1]
