"""Every query of the engine's own operators against its SQL, at the smallest scale."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__
from storyloom.plans import catalog


@pytest.fixture(scope="module")
def sql(small):
    found = duckdb.connect()
    for file in glob.glob(f"{small}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return found


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, small, sql, name):
    df = catalog.QUERIES[name](spark, small)
    got = df.collect()
    if name in catalog.SQL:
        want = sql.sql(catalog.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
