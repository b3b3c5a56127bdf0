"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = check.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got
    statement = entry.oracle_sql().get(name)
    if statement:
        cursor = con.execute(statement)
        columns = [d[0] for d in cursor.description]
        assert sorted(frame.columns) == sorted(columns)
        assert got == check.rows_of(columns, cursor.fetchall())
