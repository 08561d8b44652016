"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from keyspan.plans import catalogue, solver_queries, text_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


def table(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in df[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    got_names, got = table(catalogue.QUERIES[name](spark, SMALL).toPandas())
    want_names, want = table(duck.execute(catalogue.SQL[name]).df())
    assert got_names == want_names
    assert len(got) == len(want)
    assert got == want


def test_rows_only_queries(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and 0.5 <= row[0]["auc"] <= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
