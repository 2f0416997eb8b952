"""Every registered query against its SQL in DuckDB on small tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if name in entry.registry.QUERIES:
        assert sql is not None, "every query of the reference's operators has SQL"
    if sql is None:
        assert df.limit(1).count() == 1
    else:
        assert differences(df, duck, sql) == []


def test_no_sql_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
