"""Where queries and their SQL are registered."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = dt.datetime(2024, 1, 31)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def chosen(key: str, values: list[str | None]) -> str:
    """An expression in the SQL of both engines: the value whose place is the key modulo their number."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted[:-1]))
    return f"(CASE {key} % {len(values)} {whens} ELSE {quoted[-1]} END)"
