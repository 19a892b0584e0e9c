"""Stored tables bucketed by their key, so that a batch moves to them and they never move."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from talentweave.sources.shared import shared_path

KEYS = ("source_id", "external_id")


def save_bucketed(rows: DataFrame, table: str, keys: tuple[str, ...] = KEYS, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``rows`` as the table ``table``, dealt to buckets by ``keys`` and sorted in them; what it held before goes.

    Joins and groupings by the keys then read the table as it lies.  One exchange deals the rows, so that each bucket is
    one file.  ``buckets`` are as many as shuffle partitions if not given.  They may be more, but not fewer: against fewer
    Spark would rather deal both sides anew.  With ``path`` the table lies there.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = buckets or least
    if n < least:
        raise ValueError(f"{n} buckets are fewer than the session's {least} shuffle partitions")
    writer = rows.repartition(n, *keys).write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def bucketed_scratch(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``save_bucketed``, under a name of its own in the shared folder; its files go when the session's JVM ends."""
    spark = rows.sparkSession
    return save_bucketed(rows, f"stored_{uuid.uuid4().hex}", keys, path=shared_path(spark, "stored"))


def replace_bucketed(spark: SparkSession, table: str, rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """New rows in place of those that ``table`` holds, also where they are worked out from them.

    They are written beside it first, with as many buckets, and the names change places when that is done.  ``rows``
    that come of a join with the table by its keys lie in its buckets still, and are written without an exchange.
    """
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    n, new, old = int(about["Num Buckets"]), f"{table}_{uuid.uuid4().hex}", f"{table}_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(new)
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")
    return spark.table(table)
