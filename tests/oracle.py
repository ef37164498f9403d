"""Comparing a query with its SQL on the same Parquet files."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        files = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else x + 0.0
    if isinstance(x, pd.Timestamp):
        return None if x is pd.NaT else str(x.tz_localize(None) if x.tzinfo is None else x.tz_convert(None))
    if hasattr(x, "normalize") and hasattr(x, "as_tuple"):
        return float(x)
    return None if x is None or x is pd.NaT else str(x)


def bag(table):
    df = table.to_pandas(date_as_object=True)
    df = df[sorted(df.columns)]
    return Counter(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


def assert_equal(df, con, sql):
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    a, b = bag(got), bag(want)
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2])
