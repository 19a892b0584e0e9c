"""Pages of listings: known rows, duplicates, caps, stops and the budget of detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions.text import blank, filled
from talentweave.operators.dedupe import keep_first
from talentweave.operators.keyfilter import key_filter, may_match
from talentweave.operators.sizes import looked_up


def with_known(listings: DataFrame, known: DataFrame, prune: bool = False) -> DataFrame:
    """Listings with what is known of them: missing texts filled, flags known_listing and needs_detail.

    With ``prune`` the listings' keys are read first, and rows of ``known`` that can't be among them are dropped where
    they are scanned, before the join moves them: for few listings against a large index.
    """
    if prune:
        keys = ["source_id", "external_id"]
        known = may_match(known, key_filter(listings, keys), keys)
    fields = ("description", "employment_text", "salary_text")
    old = known.select(
        "source_id", "external_id", *[F.col(c).alias(f"k_{c}") for c in fields], F.col("listing_hash").alias("k_hash"),
        F.lit(True).alias("k_is")
    )
    rows = listings.join(old.hint("merge"), ["source_id", "external_id"], "left")
    same = F.coalesce(F.col("k_hash") == F.col("listing_hash"), F.lit(False))
    salary_missing = (F.col("source_type") == "clearance") & blank(F.col("salary_text")) & blank(F.col("k_salary_text")) if "source_type" in listings.columns else F.lit(False)
    needs = F.col("k_is").isNull() | blank(F.col("k_description")) | ~same | salary_missing
    rows = rows.withColumns({"known_listing": same, "needs_detail": needs})
    return rows.withColumns({c: filled(F.col(c), F.col(f"k_{c}")) for c in fields}).drop(*[f"k_{c}" for c in fields], "k_hash", "k_is")


def dedupe_page(listings: DataFrame) -> DataFrame:
    """The first row of each raw id, else URL, else title and company, on a page; rows without a title go."""
    key = F.coalesce(F.nullif(F.col("raw_id"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.concat_ws("|", "title", "company"))
    return keep_first(listings.where(~blank(F.col("title"))), ["source_id", "page", key], ["pos"])


def dedupe_source(listings: DataFrame) -> DataFrame:
    return keep_first(listings, ["source_id", "external_id"], ["page", "pos"])


def cap(listings: DataFrame, most: int = 120) -> DataFrame:
    """The first rows of each source."""
    w = Window.partitionBy("source_id").orderBy("page", "pos")
    return listings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def page_counts(listings: DataFrame, known: Column) -> DataFrame:
    return listings.groupBy("source_id", "page").agg(F.count("*").alias("n_rows"), F.count_if(known).alias("n_known"))


def mostly_known(n: Column, known: Column) -> Column:
    """At least 5 rows, at least 85 % known, and no more new ones than a sixth (one is always allowed)."""
    return (n >= 5) & (known / n >= 0.85) & (n - known <= F.greatest(F.lit(1), F.floor(n / 6)))


def stop_pages(pages: DataFrame, least_page: int = 3, streak: int = 2) -> DataFrame:
    """(source_id, stop_page): the first page that ends a streak of mostly known pages."""
    w = Window.partitionBy("source_id").orderBy("page").rowsBetween(1 - streak, 0)
    known = F.when(mostly_known(F.col("n_rows"), F.col("n_known")), 1).otherwise(0)
    run = pages.withColumn("run", F.sum(known).over(w))
    return run.where((F.col("page") >= least_page) & (F.col("run") == streak)).groupBy("source_id").agg(F.min("page").alias("stop_page"))


def early_stop(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Listings up to the page at which their source stops."""
    stops = looked_up(stop_pages(pages), "stops")
    return listings.join(stops, "source_id", "left").where("stop_page is null or page <= stop_page").drop("stop_page")


def empty_stop(listings: DataFrame, fetched: DataFrame, max_pages: int) -> DataFrame:
    """Listings before their source's first page without rows, and within the most pages allowed."""
    has = listings.select("source_id", "page").distinct().withColumn("has", F.lit(True))
    first = fetched.join(has, ["source_id", "page"], "left").where("has is null").groupBy("source_id").agg(F.min("page").alias("end"))
    return listings.join(
        looked_up(first, "ends"), "source_id", "left"
    ).where((F.col("end").isNull() | (F.col("page") < F.col("end"))) & (F.col("page") <= max_pages)).drop("end")


def detail_budget(listings: DataFrame, most: int = 10) -> DataFrame:
    """The first listings of each source that need their detail page."""
    return cap(listings.where("needs_detail"), most)


def override(listings: DataFrame, details: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Detail values over list values where they are not empty."""
    new = details.select(*keys, *[F.col(c).alias(f"d_{c}") for c in fields])
    return listings.join(new.hint("merge"), keys, "left").withColumns(
        {c: F.coalesce(F.nullif(F.col(f"d_{c}"), F.lit("")), F.col(c)) for c in fields}
    ).drop(*[f"d_{c}" for c in fields])


def first_company(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The company of the first row that names one."""
    return rows.where(~blank(F.col("company"))).groupBy(*keys).agg(F.min_by("company", "pos").alias("company"))


def merge_pages(captures: DataFrame) -> DataFrame:
    """Rows of several captured pages, each raw id, URL, title, company and place once, first page first."""
    return keep_first(captures, ["batch", "raw_id", "url", "title", "company", "location"], ["page_no", "pos"])


def last_page_fields(pages: DataFrame, fields: list[str]) -> DataFrame:
    return pages.groupBy("batch").agg(F.max_by(F.struct(*fields), "page_no").alias("m")).select("batch", "m.*")
