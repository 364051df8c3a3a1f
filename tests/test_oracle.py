"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from plumbline.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.columns and df.count() >= 0
        return
    diff = compare(df, con, ORACLES[name])
    # some planted faults do not occur in a few hundred rows
    assert diff is None or diff.startswith("EMPTY"), diff


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 48 and df.columns == ["period", "value", "rows"]
