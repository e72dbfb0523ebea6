"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (str, bool)):
        return str(value)
    return round(float(value), 6)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert left == right


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[0] == "video_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
