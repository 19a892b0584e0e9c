"""Joins with tables that are small by nature, whose size is looked at before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.sources.shared import shared_path

#: A table of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its size is known and it is computed once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a hint for its join: broadcast if it has at most ``most`` rows, merged by key otherwise.

    It is written and counted at once, while the plan is still being built, since its size decides what the plan is.
    """
    rows = settled(df, name)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")
