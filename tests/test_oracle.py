"""Every query with SQL must give the same rows as DuckDB on the small tables."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(found, duck.execute(entry.oracle_sql()[name]).df()) is None
