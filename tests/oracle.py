"""Comparing a query's rows with DuckDB's over the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def _value(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(map(_value, r))) for r in frame[columns].astype(object).itertuples(index=False))


def same(df, db, sql):
    mine, theirs = rows(df.toPandas()), rows(db.execute(sql).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
