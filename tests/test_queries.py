"""Every registered query of the core against its SQL."""

import pytest
from oracle import compare, connect

from millrace.plans import data_queries, engine_queries

QUERIES = data_queries.QUERIES | engine_queries.QUERIES
SQL = data_queries.SQL | engine_queries.SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_runs(spark, name):
    from oracle import SF

    assert QUERIES[name](spark, SF).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
