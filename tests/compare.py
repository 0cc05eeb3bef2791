"""Comparison of a query with its SQL, order-insensitive and by value."""

import glob
import os

import duckdb
import pandas as pd


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map(show)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head()
