"""Every catalog query against its check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF_DIR
from tidemark.plans.catalog import QUERIES as CATALOG

QUERIES = {name: run for name, run in entry_points.queries().items() if name in CATALOG}
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in CATALOG}
TABLES = ["events", "conversations", "documents"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    rows = sorted(tuple(str(row[c]) for c in columns) for row in result.collect())
    checked = duck.execute(ORACLES[name])
    names = [c[0] for c in checked.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(row[names.index(c)]) for c in columns) for row in checked.fetchall())
    assert rows == expected
    assert rows
