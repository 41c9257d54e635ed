"""Every registered query of the rest of the library against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

from marketlens import catalogue
from tests.compare import same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, ORACLES[name], SF)
    else:
        assert df.columns and df.count() >= 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
