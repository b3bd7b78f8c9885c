"""Every query against its SQL twin, and rows of those without one."""

import pytest
from compare import check, oracle

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check(spark, con, name, SF, QUERIES, SQL)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
