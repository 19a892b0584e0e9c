"""Predicates and fixed queries over postings and sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions.dates import due
from talentweave.functions.text import fold, squeeze
from talentweave.functions.urls import host, path, source_type, source_url

# Hosts and words of the link rules.
EXCLUDED_HOSTS = (
    "indeed.com", "linkedin.com", "glassdoor.com", "ziprecruiter.com", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "youtube.com", "wikipedia.org"
)
CAREER_PATHS = ("/careers", "/career", "/jobs", "/join-us", "/joinus")
CAREER_TEXTS = ("careers", "jobs", "join us", "join-us", "open roles", "open positions")
BUNDLES = ("multiple openings", "multiple jobs", "hiring multiple", "several openings", "see all")
JOB_WORDS = ("job", "career", "opening", "position", "posting", "opportunit")


def location_has(query: str) -> Column:
    return fold(F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("description", F.lit("")))).contains(fold(F.lit(query)))


def clearance_covers(requested: list[str], terms: str = "clearance_terms") -> Column:
    wanted = F.array(*[fold(F.lit(x)) for x in requested])
    return F.size(F.array_except(wanted, F.transform(F.coalesce(terms, F.array().cast("array<string>")), fold))) == 0


def application_state(state: str) -> Column:
    status = fold(F.coalesce(F.nullif(F.col("application_status"), F.lit("")), F.lit("not_applied")))
    if state == "all":
        return F.lit(True)
    if state == "not_applied_yet":
        return status.isin("not_applied", "pending")
    if state == "pending":
        return (status == "pending") & F.coalesce("application_confirmation_needed", F.lit(False))
    return status == state


def filter_postings(
    postings: DataFrame, *, source_ids: list[int] = (), location_query: str = "", remote_mode: str = "any", job_type: str = "any",
    clearance_terms: list[str] = (), state: str = "all", active_only: bool = False
) -> DataFrame:
    """All given conditions at once; those on source and activity reach the scan."""
    if active_only:
        postings = postings.where("active")
    if source_ids:
        postings = postings.where(F.col("source_id").isin(*source_ids))
    if location_query:
        postings = postings.where(location_has(location_query))
    if remote_mode != "any":
        postings = postings.where(F.col("remote_mode") == remote_mode)
    if job_type != "any":
        postings = postings.where(F.coalesce(F.nullif(F.col("job_type"), F.lit("")), F.lit("unknown")) == job_type)
    if clearance_terms:
        postings = postings.where(clearance_covers(list(clearance_terms)))
    return postings.where(application_state(state))


def scannable(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("enabled") & (source_type(F.col("source_type"), F.col("url")) != "browser_capture"))


def manual_assist(kind: Column, browser_profile: Column) -> Column:
    return kind.isin("browser_capture", "indeed") | F.coalesce(browser_profile, F.lit(False))


def due_sources(sources: DataFrame, every_minutes: int, as_of: dt.datetime) -> DataFrame:
    return sources.where(due(F.col("last_scan_at"), every_minutes, as_of))


def unsupported_reason(kind: Column, url: Column) -> Column:
    """Why a source can't be read directly, or null."""
    return F.when(kind == "browser_capture", "captured in the browser only").when(
        host(url).endswith("linkedin.com"), "marketplace pages mix employers; use the employer's own board"
    )


def split_supported(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources to be saved, with clean URLs, and those that can't be, with the reason.

    Captures come from a browser, so a capture source is saved whatever its URL.
    """
    rows = sources.withColumn("url", source_url(F.col("url"), F.col("source_type")))
    reason = F.when(F.col("source_type") != "browser_capture", unsupported_reason(F.col("source_type"), F.col("url")))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def excluded_host(url: Column) -> Column:
    out = F.lit(False)
    for h in EXCLUDED_HOSTS:
        out = out | host(url).endswith(h)
    return out


def careers_path(url: Column) -> Column:
    return F.lower(path(url)).rlike("|".join(CAREER_PATHS))


def careers_text(text: Column) -> Column:
    return fold(text).rlike("|".join(CAREER_TEXTS))


def job_like(href: Column, title: Column) -> Column:
    return F.lower(href).rlike("|".join(JOB_WORDS)) & (F.length(title) >= 4)


def bundled(text: Column) -> Column:
    return fold(squeeze(text)).rlike(rf"\b(?:{'|'.join(BUNDLES)})\b")


def capture_needs_detail(url: Column, salary: Column, description: Column, requirements: Column) -> Column:
    """Rows of the detail-rich board that lack salary, a description of 220 characters, or requirements."""
    thin = (F.coalesce(salary, F.lit("")) == "") | (F.length(F.coalesce(description, F.lit(""))) < 220) | (F.coalesce(requirements, F.lit("")) == "")
    return host(url).contains("clearancejobs.com") & thin


def newest_postings(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Active postings with their source's name and type, newest seen first."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    return postings.where("active").join(names, "source_id").orderBy(F.desc("last_seen_at"), F.desc("id"))


def posting_by_id(postings: DataFrame, sources: DataFrame, posting_id: int) -> DataFrame:
    """One posting with its source's name and type; the filter reaches the scan."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    return postings.where(F.col("id") == posting_id).join(names, "source_id")


def known_index(postings: DataFrame) -> DataFrame:
    """What is known of the postings of each source: hashes and the texts that a listing may lack."""
    return postings.select(
        "source_id", "external_id", "content_hash", "listing_hash", "canonical_url", "description", "employment_text",
        "salary_text", "active", "last_seen_at"
    )


def ordered_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("enabled"), "name", "id")


def source_by_url(sources: DataFrame) -> DataFrame:
    """The newest source of each URL and type."""
    return sources.groupBy("url", "source_type").agg(F.max("id").alias("id"))


def latest_active(profiles: DataFrame) -> DataFrame:
    """The last updated active profile of each owner."""
    w = Window.partitionBy("owner").orderBy(F.desc("updated_at"), F.desc("id"))
    return profiles.where("is_active").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending_confirmation(postings: DataFrame, limit: int = 6) -> DataFrame:
    return postings.where("active and application_confirmation_needed").orderBy(F.desc("application_last_opened_at"), F.desc("id")).limit(limit)
