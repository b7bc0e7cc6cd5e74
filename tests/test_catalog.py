"""Every catalog query runs on the smallest tables; those with a DuckDB twin match it."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _cv(v):
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool):
        f = float(v)
        return str(int(f)) if f.is_integer() else repr(round(f, 6))
    return str(v)


def _canon(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cv(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "n" in df.columns


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:  # tested against brute force elsewhere
        assert len(s) > 0 and len(set(s.columns)) == len(s.columns) and not s.isna().all(axis=None)
        return
    d = con.sql(sql).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert _canon(s) == _canon(d)
