"""Exports of ranked matches, scan logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.functions.dates import iso

POSTING_FIELDS = (
    "source_id", "source_name", "title", "company", "location", "remote_mode", "job_type", "salary_text", "application_status",
    "clearance_terms", "url", "summary_text", "skills", "required_skills", "preferred_skills", "experience_years"
)
FLAT = (
    "title", "company", "location", "remote_mode", "job_type", "salary_text", "score", "embedding_score", "skill_score",
    "experience_score", "matched_skills", "missing_skills", "reasons", "url", "posted_at"
)


def nested(matches: DataFrame) -> DataFrame:
    """Matches with the posting as a sub-object and ISO times, as they are exported to JSON."""
    inner = [F.col(c) for c in POSTING_FIELDS if c in matches.columns]
    when = [iso(F.col("posted_at")).alias("posted_at")] if "posted_at" in matches.columns else []
    return matches.select(
        "score", "embedding_score", "skill_score", "experience_score", "matched_skills", "missing_skills", "reasons",
        F.struct(F.col("posting_id").alias("id"), *inner, *when).alias("job")
    )


def flat(matches: DataFrame) -> DataFrame:
    """Fifteen columns: scores to 4 places, lists joined by commas, reasons by bars."""
    out = []
    for c in FLAT:
        if c not in matches.columns:
            out.append(F.lit(None).cast("string").alias(c))
        elif c.endswith("score"):
            out.append(F.round(c, 4).alias(c))
        elif c in ("matched_skills", "missing_skills", "reasons"):
            out.append(F.array_join(c, ", " if c != "reasons" else " | ").alias(c))
        else:
            out.append(iso(F.col(c)).alias(c) if c == "posted_at" else F.col(c))
    return matches.select(*out)


def write_json(matches: DataFrame, path: str) -> None:
    nested(matches).write.mode("overwrite").json(path)


def write_csv(matches: DataFrame, path: str) -> None:
    flat(matches).write.mode("overwrite").option("header", True).csv(path)


def begin_scans(sources: DataFrame, started) -> DataFrame:
    """Scan log rows of a run that begins: one a source (column ``id``), running, with an id that a rerun gives again."""
    number = F.xxhash64(F.col("id"), F.lit(started))
    none = [
        F.lit(None).cast(k).alias(c) for c,
        k in (
            ("finished_at", "timestamp"),
            *[(f"jobs_{x}", "long") for x in ("found", "created", "updated", "unchanged", "deactivated")],
            ("error_text", "string")
        )
    ]
    return sources.select(
        number.alias("id"), F.col("id").alias("source_id"), F.lit(started).alias("started_at"), F.lit("running").alias("status"),
        *none
    )


def finish_scans(scans: DataFrame, results: DataFrame, finished) -> DataFrame:
    """Scan log rows closed by results (id, status, counts, error_text); rows without a result stay, unknown ids do nothing."""
    counts = [f"jobs_{x}" for x in ("found", "created", "updated", "unchanged", "deactivated")]
    given = set(results.columns)
    new = results.select(
        "id", F.col("status").alias("n_status"),
        *[(F.coalesce(c, F.lit(0)) if c in given else F.lit(0)).cast("long").alias(f"n_{c}") for c in counts],
        (F.col("error_text") if "error_text" in given else F.lit(None).cast("string")).alias("n_error_text")
    )
    rows = scans.join(new, "id", "left")
    done = F.col("n_status").isNotNull()
    changed = {"finished_at": F.when(done, F.lit(finished)).otherwise(F.col("finished_at"))} | {
        c: F.when(done, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("status", *counts, "error_text")
    }
    return rows.select(*[(changed[c] if c in changed else F.col(c)).alias(c) for c in scans.columns])


def scan_rows(counts: DataFrame, started, finished) -> DataFrame:
    """Scan log rows of one run from its counts by source."""
    found = F.col("created") + F.col("updated") + F.col("unchanged")
    return counts.select(
        "source_id", F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"), F.lit("completed").alias("status"),
        found.alias("jobs_found"), F.col("created").alias("jobs_created"), F.col("updated").alias("jobs_updated"),
        F.col("unchanged").alias("jobs_unchanged"), F.col("deactivated").alias("jobs_deactivated"),
        F.lit(None).cast("string").alias("error_text")
    )
