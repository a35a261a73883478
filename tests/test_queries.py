"""Every registered query against its SQL text on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NA or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 9)
    return x


def content(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(([cell(x) for x in row] for row in df.itertuples(index=False)), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert content(got) == content(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
