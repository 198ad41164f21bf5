"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in TESTDATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), 0 if v is None else v) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(TESTDATA))
    wanted = duck.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(wanted.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    at = [wanted.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in at) for r in wanted.fetchall()]
    assert _sorted(got) == _sorted(expected)


def test_flagship_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
