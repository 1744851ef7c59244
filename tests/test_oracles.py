"""Each registered query against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalogue

DATA = "/root/testdata/sf0.001"


def values(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind == "f":
            df[c] = df[c].astype(float).round(6)
        elif kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    rows = [tuple(None if pd.isna(x) else (float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(df.columns), sorted(rows, key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        assert values(mine) == values(duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(mine)
