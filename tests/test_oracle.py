"""Every registered query against its SQL in DuckDB, on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import pytest

from foliometer.plans import load_queries
from foliometer.plans.testdata import TABLES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

# Python decides these rows one pair or page at a time; they are tested against loops.
WITHOUT_SQL = {
    "D8_compare_pages",
    "D8_compare_documents",
    "U2_similarity",
    "W8_trend_stream_approx",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    query = QUERIES[name]
    result = query.run(spark, FOLDER)
    rows = [tuple(row) for row in result.collect()]
    if query.sql is None:
        assert name in WITHOUT_SQL
        return
    expected = database.execute(query.sql)
    columns = [column[0] for column in expected.description]
    assert sorted(columns) == sorted(result.columns)
    assert normal(rows, result.columns) == normal(expected.fetchall(), columns)
