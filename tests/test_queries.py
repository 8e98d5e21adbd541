"""Every named query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, oracle

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        compare(spark, con, QUERIES[name], SQL[name], SF_DIR)
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0
