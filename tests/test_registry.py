"""Every registered query runs, and equals its SQL form where it has one."""

import pytest
from check import compare, database

from tidemark.registry.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SMALL) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_has_rows(spark, name):
    assert not QUERIES[name](spark, SMALL).isEmpty()


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
