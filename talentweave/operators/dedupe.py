"""One row of each group of equal postings, pages or listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions.text import filled
from talentweave.functions.urls import posting_key


def best_of(df: DataFrame, key: Column, *rank: Column) -> DataFrame:
    """The row of the greatest rank of each key; a total order of the rank makes it one answer.

    ``max_by`` is combined on the map side, so a hot key sends one row a task.  It is a barrier: filters that are
    meant to work on the winners alone can't be pushed below it.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key.alias("_key")).agg(F.max_by(row, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("_row")).select("_row.*")


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def application_priority(status: Column, confirm: Column) -> Column:
    return F.when(F.coalesce(confirm, F.lit(False)), 3).when(status == "applied", 2).when(status == "not_interested", 1).otherwise(0)


def dedupe_postings(postings: DataFrame) -> DataFrame:
    """Postings of one canonical key become the one furthest in application, richest, and last seen."""
    canonical = filled(F.col("canonical_url"), F.col("url"))
    key = posting_key(F.col("title"), F.col("company"), F.col("location"), canonical, F.col("job_type"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return best_of(
        postings, key,
        application_priority(F.col("application_status"), F.col("application_confirmation_needed")),
        F.length(F.coalesce("description", F.lit(""))), size(F.col("required_skills")), size(F.col("skills")),
        F.coalesce("last_seen_at", "last_updated_at", "first_seen_at"), F.col("last_seen_at"), F.col("id"),
    )
