"""Comparing a query with its SQL: columns by name, rows as a multiset."""

import os

import duckdb
import pandas as pd


def tables(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _value(v):
    if v is None or not hasattr(v, "__len__") and pd.isna(v):
        return None
    return float(v) if hasattr(v, "__float__") and str(v) not in ("True", "False") and not isinstance(v, str) else str(v)


def multiset(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr([_value(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


def compare(spark_df, con, sql):
    got, want = multiset(spark_df.toPandas()), multiset(con.execute(sql).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]
