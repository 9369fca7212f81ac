"""The registered queries against DuckDB on the smallest tables."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from quern import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def same(spark, duck, run, sql):
    a, b = run(spark, DATA).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    same(spark, duck, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert math.isfinite(entry.entry(spark).first()[2])
