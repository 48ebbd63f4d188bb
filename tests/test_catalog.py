"""Every registered query against its oracle, and the driver contract."""

import pytest

import __spark_entry__ as entry_point
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        difference = compare(con, df, ORACLES[name])
        assert difference in ("", "no rows")
    else:
        assert df.count() >= 0


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 1
