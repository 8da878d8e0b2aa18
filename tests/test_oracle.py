"""Every query with SQL gives what DuckDB gives on the smallest tables; every other one runs and has a stable schema."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, (norm(v) for v in r))) for r in df.select(*columns).collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(str(norm(r[i])) for i in order) for r in result.fetchall())
    assert got == want


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["at", "file", "idx", "event_id", "value"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
