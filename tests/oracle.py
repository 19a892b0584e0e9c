"""Compares a query with its SQL in DuckDB on the same tables, whatever the rows' order."""

from __future__ import annotations

import numbers
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, numbers.Number) and v != v):
        return None
    return round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_plain, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


def assert_same(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = query(spark, DATA).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
