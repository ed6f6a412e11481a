"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], ORACLE.get(name), SF)
    assert ok, message


def test_entry_gives_the_flagship(spark):
    df = entry.entry(spark)
    assert 0 < df.count() <= 50 and df.columns[0] == "normalized_hash"
