"""Scan reports, dashboard counts, display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.urls import source_type
from talentweave.operators.filters import manual_assist


def recent_scans(scans: DataFrame, sources: DataFrame, limit: int = 25) -> DataFrame:
    """The newest scans with their sources' names; a missing source is named by its id."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("known_name"))
    name = F.coalesce(
        "known_name", F.when(F.col("source_id").isNotNull(), F.concat(F.lit("Source #"), F.col("source_id").cast("string"))),
        F.lit("Unknown source")
    )
    return scans.join(names, "source_id", "left").withColumn("source_name", name).drop("known_name").orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def scan_summary(results: DataFrame) -> DataFrame:
    """One row: totals of all results, counts by status, results with an error or a block."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("jobs_found", "jobs_created", "jobs_updated", "jobs_unchanged", "jobs_deactivated")]
    states = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("completed", "error", "blocked")]
    return results.agg(F.count("*").alias("n_sources"), *sums, *states, F.count_if(F.col("status").isin("error", "blocked")).alias("n_issues"))


def scan_totals(results: DataFrame) -> DataFrame:
    """Running totals of each source."""
    sums = [F.sum(c).alias(c) for c in ("jobs_created", "jobs_updated", "jobs_unchanged")]
    return results.groupBy("source_id").agg(
        F.count("*").alias("n_scans"), *sums, F.count_if(F.col("status").isin("error", "blocked")).alias("n_issues")
    )


def unmatched(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """Postings that are in no ranking; duplicates that were merged away count as unmatched."""
    return postings.join(matches.select(F.col("posting_id").alias("id")).distinct().hint("merge"), "id", "left_anti")


def dashboard(postings: DataFrame, matches: DataFrame, sources: DataFrame, pending: int = 6) -> DataFrame:
    """One row of counts: postings held, those that wait for a confirmation (at most ``pending`` shown), matched and
    not, and sources that can be scanned, or need a person at the browser."""
    found = matches.select(F.col("posting_id").alias("id")).distinct().withColumn("is", F.lit(True)).hint("merge")
    waits = F.coalesce(F.col("active") & F.col("application_confirmation_needed"), F.lit(False))
    held = postings.join(found, "id", "left").agg(
        F.count("*").alias("n_cached"), F.least(F.count_if(waits), F.lit(pending)).alias("n_pending"),
        F.count_if(F.col("is").isNotNull()).alias("n_matched"), F.count_if(F.col("is").isNull()).alias("n_unmatched"),
    )
    kind = source_type(F.col("source_type"), F.col("url"))
    asked = sources.agg(
        F.count_if(F.col("enabled") & (kind != "browser_capture")).alias("n_scannable"), F.count_if(manual_assist(kind, F.lit(False))).alias("n_manual"), F.max("last_scan_at").alias("last_scan_at"),
    )
    both = held.unionByName(asked, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def scan_note(row: str = "") -> Column:
    """What is told of a finished scan: its error if it failed, else what was read."""
    c = lambda name: F.col(f"{row}{name}")
    read = F.concat(
        c("jobs_found").cast("string"), F.lit(" job(s) across "), c("pages_scanned").cast("string"), F.lit(" page(s); "),
        c("detail_pages_fetched").cast("string"), F.lit(" detail page(s)"), F.when(
            c("stopped_early"), "; stopped early after mostly-known pages"
        ).otherwise(""),
    )
    error = F.nullif(c("error_text"), F.lit(""))
    failed = F.when(
        c("status") == "cancelled", F.coalesce(error, F.lit("Cancelled before completion."))
    ).when(c("status").isin("blocked", "error"), error)
    return F.coalesce(failed, read)


def change_text(created: Column, updated: Column, unchanged: Column) -> Column:
    return F.concat(F.lit("+"), created.cast("string"), F.lit(" / ~"), updated.cast("string"), F.lit(" / ="), unchanged.cast("string"))


# Labels shown for stored values.
MODE_LABELS = {"remote": "Remote", "hybrid": "Hybrid", "on-site": "On-site"}
STATE_LABELS = {"applied": "Applied", "pending": "Pending", "not_interested": "Not interested"}


def label(c: Column, labels: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def result_rows(matches: DataFrame) -> DataFrame:
    """Ranked matches as display columns."""
    pay = F.concat_ws(" | ", F.nullif(F.col("job_type"), F.lit("")), F.nullif(F.col("salary_text"), F.lit("")))
    return matches.select(
        "profile_id", "posting_id", "title", "company", pay.alias("terms"), label(F.col("remote_mode"), MODE_LABELS, "Unknown").alias("mode"),
        label(F.col("application_status"), STATE_LABELS, "Not applied").alias("state"), F.concat(
            F.bround(F.col("score") * 100, 0).cast("int").cast("string"), F.lit("%")
        ).alias("score_text"),
    )
