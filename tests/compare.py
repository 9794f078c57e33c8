"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os
from glob import glob

import duckdb
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame):
    show = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def assert_same(spark, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), views(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
