"""Every query that has SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TALLYWEIR_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 4) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    there = duck.execute(SQL[name])
    names = [c[0] for c in there.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(str([plain(r[c]) for c in order]) for r in found.collect())
    theirs = sorted(str([plain(v) for _, v in sorted(zip(names, row))]) for row in there.fetchall())
    assert ours == theirs
