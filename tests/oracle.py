"""Runs a query on Spark and its twin on DuckDB and tells how they differ."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def text(v) -> str:
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, (float,)):
            return f"{v + 0.0:.6f}" if v else "0.000000"
        if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


def difference(spark_df, con, sql: str) -> str | None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows, such as {bad[0]} ({sorted(got.columns)})" if bad else None
