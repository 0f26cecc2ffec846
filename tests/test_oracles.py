"""Every query that has SQL gives the same rows as that SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points

SQL = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
