"""Payload rows to postings, optional enrichment, rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions.dates import parse_time
from talentweave.functions.text import blank, clean_text, distinct_folded, distinct_sorted, excerpt, filled, joined_distinct, lines, section_after, squeeze, text_hash
from talentweave.functions.urls import canonical_url
from talentweave.operators.annotate import clearance, job_type, salary, work_mode, years_mentioned
from talentweave.operators.sizes import looked_up
from talentweave.operators.terms import terms_column

# Headers of the required and preferred parts of a description.
REQUIRED_HEADER = r"(?:requirements|qualifications|must have|what you[' ]?ll need|what we[' ]?re looking for)"
PREFERRED_HEADER = r"(?:preferred|nice to have|bonus points|would be great|desired qualifications)"
PAYLOAD = (
    "raw_id", "external_id", "title", "company", "location", "summary", "description", "requirements_text", "preferred_text",
    "salary_text", "employment_text", "job_type", "remote_mode", "url", "posted_at"
)


def split_valid(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a title, and the others with the reason."""
    bad = blank(squeeze(F.col("title")))
    return payloads.where(~bad), payloads.where(bad).withColumn("reason", F.lit("missing title"))


def external_id(source_id: Column, external: Column, raw: Column, title: Column, company: Column, url: Column) -> Column:
    named = F.concat_ws(":", F.coalesce(source_id.cast("string"), F.lit("")), squeeze(title), squeeze(company), F.coalesce(url, F.lit("")))
    return F.coalesce(F.nullif(external, F.lit("")), F.nullif(raw, F.lit("")), text_hash(named))


def listing_hash(title: Column, company: Column, location: Column, summary: Column, posted: Column, url: Column) -> Column:
    return text_hash(F.concat_ws("\n", *[squeeze(c) for c in (title, company, location, summary, posted)], canonical_url(url)))


def normalize_postings(payloads: DataFrame, sources: DataFrame, skills: dict[str, list[str]], enrichment: DataFrame | None = None) -> DataFrame:
    """Postings from payload rows that have a title; one chain of columns, no shuffle but the joins.

    Absent payload columns count as null.  Without a requirements part all skills count as required; given work mode,
    job type, listing hash and canonical URL win over derived ones.
    """
    have = set(payloads.columns)
    rows = payloads.select(
        F.col("source_id").cast("long").alias("source_id"),
        *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in PAYLOAD]
    )
    names = sources.select(
        F.col("id").cast("long").alias("source_id"), F.col("name").alias("source_name"), F.col("url").alias("source_url"),
        "source_type"
    )
    rows = split_valid(rows)[0].join(looked_up(names, "sources"), "source_id", "left")
    url = filled(F.col("url"), F.col("source_url"))
    company = squeeze(filled(F.col("company"), F.col("source_name")))
    rows = rows.withColumns(
        {
            "raw_company": company, "given_url": url,
            "clean_description": clean_text(filled(F.col("description"), F.col("summary"))), "title": squeeze(F.col("title")),
            "location_": squeeze(F.col("location")), "pay": squeeze(F.col("salary_text")),
            "terms": squeeze(F.col("employment_text"))
        }
    )
    description = F.col("clean_description")
    everything = lines(F.col("title"), F.col("raw_company"), F.col("location_"), description, F.col("requirements_text"))
    required = F.when(~blank(F.col("requirements_text")), squeeze(F.col("requirements_text"))).otherwise(section_after(description, REQUIRED_HEADER))
    preferred = F.when(~blank(F.col("preferred_text")), squeeze(F.col("preferred_text"))).otherwise(section_after(description, PREFERRED_HEADER))
    rows = rows.withColumns({
        "required_": required, "preferred_": preferred,
        "external_id": external_id(F.col("source_id"), F.col("external_id"), F.col("raw_id"), F.col("title"), company, url),
        "listing_hash": listing_hash(
            F.col("title"), company, F.col("location"), filled(F.col("summary"), F.col("description")),
            F.coalesce("posted_at", F.lit("")), url
        ),
        "canonical_url": canonical_url(url),
        "clear": clearance(everything), "paid": salary(
            lines(F.col("salary_text"), F.col("summary"), description, F.col("terms"))
        ), "all_skills": terms_column(everything, skills),
        "remote_mode": F.coalesce(F.nullif("remote_mode", F.lit("")), work_mode(F.concat_ws(" ", "location_", description))),
        "job_type": F.coalesce(F.nullif("job_type", F.lit("")), job_type(lines(F.col("title"), description, F.col("terms"), F.col("pay")))),
    })
    out = rows.select(
        "source_id", "source_name", "source_type", "external_id", "title", F.col("raw_company").alias("company"), F.col("location_").alias("location"), "remote_mode", "job_type",
        F.col("clear.terms").alias("clearance_terms"), F.col("clear.summary").alias("clearance_summary"), F.col("paid.low").alias("salary_min"), F.col("paid.high").alias("salary_max"), F.col("paid.currency").alias("salary_currency"),
        F.col("paid.interval").alias("salary_interval"), F.col("paid.display").alias("salary_text"), parse_time(F.col("posted_at")).alias("posted_at"), F.col("given_url").alias("url"), description.alias("description"),
        F.col("all_skills").alias("skills"), F.when(
            F.col("required_") != "", terms_column(F.col("required_"), skills)
        ).otherwise(F.col("all_skills")).alias("required_skills"), terms_column(F.col("preferred_"), skills).alias("preferred_skills"),
        years_mentioned(filled(F.col("required_"), description)).alias("experience_years"), F.when(
            F.col("paid.display").isNull() & (F.col("pay") != ""), joined_distinct(F.col("terms"), F.col("pay"))
        ).otherwise(F.col("terms")).alias("employment_text"),
        "listing_hash", "canonical_url", F.lit("").alias("told_summary"),
    )
    if enrichment is not None:
        out = enrich_postings(out, enrichment)
    return out.withColumn("summary_text", posting_summary()).withColumn("content_hash", text_hash(F.col("summary_text")))


def posting_summary() -> Column:
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(c, 1, 16), ", ")))
    told = lambda name, c: F.when(~blank(F.col(c)), F.concat(F.lit(f"{name}: "), F.col(c)))
    clipped = F.nullif(excerpt(F.col("description"), 900), F.lit(""))
    return F.concat_ws(
        "\n", F.concat(F.col("title"), F.lit(" at "), F.col("company")), told("Location", "location"),
        told("Remote mode", "remote_mode"), told("Type", "job_type"), told("Salary", "salary_text"),
        told("Clearance", "clearance_summary"), listed("Required skills", F.col("required_skills")),
        listed("Preferred skills", F.col("preferred_skills")), told("LLM summary", "told_summary"), clipped
    )


def _united(c: str) -> Column:
    none = F.array().cast("array<string>")
    return distinct_sorted(F.concat(F.coalesce(c, none), F.coalesce(f"e_{c}", none)))


def enrich_postings(postings: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Lists united, gaps filled, the larger number of years; preferred skills that are required go."""
    keys = ["source_id", "external_id"]
    new = enrichment.select(*keys, F.lit(True).alias("e_is"), *[F.col(c).alias(f"e_{c}") for c in enrichment.columns if c not in keys])
    rows = postings.join(new, keys, "left")
    read = salary(F.coalesce("e_salary_text", F.lit("")))
    gap = blank(F.col("salary_text")) & ~blank(F.col("e_salary_text"))
    rows = rows.withColumns({
        "required_skills": _united("required_skills"), "skills": _united("skills"), "clearance_terms": _united("clearance_terms"), "preferred_skills": _united("preferred_skills"),
        "salary_min": F.when(gap, read["low"]).otherwise(F.col("salary_min")), "salary_max": F.when(gap, read["high"]).otherwise(F.col("salary_max")), "salary_interval": F.when(gap, read["interval"]).otherwise(F.col("salary_interval")),
        "salary_text": F.when(gap, F.coalesce(read["display"], squeeze(F.col("e_salary_text")))).otherwise(F.col("salary_text")),
        "job_type": F.when(blank(F.col("job_type")), F.nullif(squeeze(F.col("e_job_type")), F.lit(""))).otherwise(F.col("job_type")),
        "remote_mode": F.when(
            (F.col("remote_mode") == "unknown") & ~blank(F.col("e_remote_mode")), squeeze(F.col("e_remote_mode"))
        ).otherwise(F.col("remote_mode")),
        "experience_years": F.greatest(
            "experience_years", F.when(F.col("e_experience_years_hint") > 0, F.col("e_experience_years_hint"))
        ), "told_summary": squeeze(F.col("e_short_summary")),
    })
    told = F.coalesce("e_is", F.lit(False))
    rows = rows.withColumn("preferred_skills", F.filter("preferred_skills", lambda s: ~told | ~F.array_contains(F.col("required_skills"), s)))
    rows = rows.withColumn(
        "clearance_summary",
        F.when(told & (F.size("clearance_terms") > 0), F.array_join("clearance_terms", ", ")).otherwise(F.col("clearance_summary"))
    )
    return rows.select(*postings.columns)


def enrich_profiles(profiles: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Lists united (titles in order, at most 8), the larger number of years."""
    new = enrichment.select("resume_id", *[F.col(c).alias(f"e_{c}") for c in enrichment.columns if c != "resume_id"])
    rows = profiles.join(new, "resume_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: _united(c) for c in ("skills", "tools", "certifications", "clearance_terms")})
    rows = rows.withColumn("titles", F.slice(distinct_folded(F.concat(F.coalesce("titles", none), F.coalesce("e_recent_titles", none))), 1, 8))
    rows = rows.withColumn("experience_years", F.greatest("experience_years", F.col("e_experience_years_hint")))
    return rows.select(*profiles.columns)


def to_enrich(postings: DataFrame, limit: int = 20, least: int = 120) -> DataFrame:
    """The first postings with a long enough description; limit 0 takes all."""
    rows = postings.where(F.length(F.coalesce("description", F.lit(""))) >= least)
    if not limit:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).where(F.col("_n") <= limit).drop("_n")


REPLY = T.StructType(
    [T.StructField(c, T.StringType() if c in ("salary_text", "job_type", "remote_mode", "short_summary") else T.DoubleType() if c == "experience_years_hint" else T.ArrayType(T.StringType())) for c in ("required_skills", "preferred_skills", "skills", "clearance_terms", "salary_text", "job_type", "remote_mode", "experience_years_hint", "short_summary")]
)


def parse_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Enrichment fields from JSON replies: the text itself, else its outermost braces; others give no row."""
    body = F.when(F.try_parse_json(text).isNotNull(), F.col(text)).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    rows = replies.withColumn("_r", F.from_json(body, REPLY)).where(F.try_parse_json(body).isNotNull() & (F.trim(body) != ""))
    return rows.select(*[c for c in replies.columns if c != text], "_r.*")


