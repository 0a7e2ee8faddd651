"""Every registered query with an oracle, against DuckDB on the smallest tables; and the entry points."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = {n: m.SQL.get(n) for m in entry.MODULES for n in m.Q}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if v is None or v is pd.NA or v != v:
        return "null"
    return round(float(v), 5) if isinstance(v, Number) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(n for n, sql in PLAIN.items() if sql))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.sql(PLAIN[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n, sql in PLAIN.items() if not sql))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_blend_has_every_component(spark):
    got = entry.queries()["vector_blend"](spark, DIR).groupBy("vec_id").count()
    assert {r["count"] for r in got.collect()} == {64}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
