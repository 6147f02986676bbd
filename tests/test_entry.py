"""Every registered query against its SQL, on the smallest test tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# Queries of the optional training-data operators have their own tests.
QUERIES = {k: f for k, f in entry.queries().items() if f.__module__.startswith("workload.")}
ORACLE = {k: sql for k, sql in entry.oracle_sql().items() if k in QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows_of(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        return repr(float(x)) if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        assert rows_of(got) == rows_of(duck.execute(ORACLE[name]).df())
    else:
        assert len(got) > 0
