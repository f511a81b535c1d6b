"""Every registered query against its SQL text, on the smallest tables."""

import pytest
from harness import connect, difference

from tallywind.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_matches_oracle(spark, con, key):
    assert difference(QUERIES[key](spark, SF), con, ORACLES[key]) is None


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["position", "team_id", "team_name", "rank", "value"] and df.count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
