"""Every registered query on the smallest tables, against DuckDB where an oracle exists."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, diff

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert diff(got, con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
