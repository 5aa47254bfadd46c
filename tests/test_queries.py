"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "power", "src_ord", "confidence"] and df.count() == 150
