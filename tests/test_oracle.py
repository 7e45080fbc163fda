"""Every domain query against its SQL, run by DuckDB on the same files."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from quern.plans.oracle import SQL
from quern.plans.queries import QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TINY):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TINY}/{f}'")
    return c


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, numbers.Number) and not isinstance(x, bool):
        return round(float(x), 6)
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, TINY).toPandas(), duck.sql(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_context_text(spark):
    r = QUERIES["context_text"](spark, TINY).first()
    assert r.n_bytes == len(r.context.encode()) <= 4000 and r.context.endswith("</memory-context>") and "## Recent Memories" in r.context
