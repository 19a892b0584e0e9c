"""Readers of landed files: texts, board JSON, postings JSON, pages, capture batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.functions.text import blank, clean_text, filled, squeeze, strip_html
from talentweave.functions.urls import canonical_url, capture_url

BOARD = "jobs array<struct<id:string,title:string,absolute_url:string,updated_at:string,content:string,location:struct<name:string>>>"
POSTINGS = "id string, text string, hostedUrl string, descriptionPlain string, createdAt bigint, categories struct<location:string,commitment:string,team:string>, lists array<struct<text:string,content:string>>"
CAPTURED = "array<struct<raw_id:string,external_id:string,title:string,company:string,location:string,summary:string,description:string,requirements_text:string,salary_text:string,employment_text:string,url:string,posted_at:string>>"
CAPTURE = f"parser string, page struct<url:string,title:string,site:string,parser:string,captured_at:string,captured_page_count:int,next_page_url:string>, source struct<id:bigint,url:string,site:string,company:string,name:string>, jobs {CAPTURED}"


def resume_texts(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """(filename, text, status): whole text files; others and too short ones are marked, not dropped."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text")
    )
    kind = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return rows.withColumn(
        "status",
        F.when(~kind.isin("txt", "md"), "unsupported").when(F.length(squeeze(F.col("text"))) < least, "too short").otherwise("ok")
    )


def board_payloads(spark: SparkSession, path: str, source_id: int) -> DataFrame:
    """Payload rows of a board's JSON: one per element of ``jobs``."""
    rows = spark.read.schema(BOARD).option("multiLine", True).json(path).select(F.posexplode("jobs").alias("pos", "j"))
    return rows.select(
        F.lit(source_id).cast("long").alias("source_id"), F.lit(1).alias("page"), "pos", F.col("j.id").alias("raw_id"), F.col("j.title").alias("title"), F.col("j.location.name").alias("location"),
        strip_html(F.col("j.content")).alias("description"), F.col("j.absolute_url").alias("url"), F.col("j.updated_at").alias("posted_at"),
    )


def postings_payloads(spark: SparkSession, path: str, source_id: int) -> DataFrame:
    """Payload rows of a top-level array of postings; lists become the requirements, epoch milliseconds the date."""
    rows = spark.read.schema(POSTINGS).option("multiLine", True).json(path)
    return rows.select(
        F.lit(source_id).cast("long").alias("source_id"), F.col("id").alias("raw_id"), F.col("text").alias("title"), F.col("categories.location").alias("location"), F.col("categories.commitment").alias("employment_text"),
        F.col("descriptionPlain").alias("description"), F.array_join(
            F.transform(
                F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>")),
                lambda x: strip_html(F.concat_ws(" ", x["text"], x["content"]))
            ),
            "\n"
        ).alias("requirements_text"),
        F.col("hostedUrl").alias("url"), F.col("createdAt").cast("string").alias("posted_at"),
    )


def pages(spark: SparkSession, path: str, layout: str = "", kind: str = "parquet") -> DataFrame:
    """Captured pages (page_id, url, html, layout) from a table, or from saved files."""
    if kind == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html", F.lit(layout).alias("layout"))
    rows = spark.read.text(path, wholetext=True)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("page_id"), F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"), F.lit(layout).alias("layout")
    )


def pages_of(pages_: DataFrame, urls: DataFrame) -> DataFrame:
    """The pages whose canonical URL is asked for."""
    wanted = urls.select(canonical_url(F.col("url")).alias("_u")).distinct()
    return pages_.withColumn("_u", canonical_url(F.col("url"))).join(wanted, "_u", "left_semi").drop("_u")


def captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE).option("multiLine", True).json(path)


def capture_rows(batches: DataFrame) -> DataFrame:
    """Rows of capture batches with their page's fields, cleaned and with URL and raw id filled."""
    rows = batches.select("parser", "page", "source", F.posexplode("jobs").alias("pos", "j"))
    raw = squeeze(filled(F.col("j.raw_id"), F.col("j.external_id")))
    url = capture_url(F.col("j.url"), F.col("page.url"), raw)
    summary = clean_text(F.col("j.summary"))
    rows = rows.select(
        F.col("source.id").alias("source_id"), F.col("page.url").alias("page_url"), "pos", F.when(raw != "", raw).otherwise(url).alias("raw_id"), squeeze(F.col("j.title")).alias("title"), squeeze(
            filled(F.col("j.company"), F.col("source.company"), F.col("source.name"))
        ).alias("company"),
        squeeze(F.col("j.location")).alias("location"), summary.alias("summary"), clean_text(filled(
            F.col("j.description"), F.col("j.summary")
        )).alias("description"), F.col("j.requirements_text").alias("requirements_text"), F.col("j.salary_text").alias("salary_text"),
        squeeze(F.col("j.employment_text")).alias("employment_text"), url.alias("url"), url.alias("canonical_url"), F.col("j.posted_at").alias("posted_at"), F.lit("browser_extension").alias("capture_mode"), squeeze(F.col("page.title")).alias("captured_page_title"),
        squeeze(F.col("page.site")).alias("captured_site"), squeeze(filled(F.col("parser"), F.col("page.parser"))).alias("capture_parser"),
    )
    return rows


def resolve_sources(batches: DataFrame, sources: DataFrame) -> DataFrame:
    """Each batch's source: by id, else the newest capture source of the page's URL, else a new row to be stored.

    New rows have a null source_id and a name from company, site or title; batches of one new page make one row, so
    that they get one source.
    """
    rows = batches.select("page", "source", F.coalesce("jobs", F.array().cast(CAPTURED)).alias("jobs"))
    ids = sources.select(F.col("id").alias("by_id"))
    urls = sources.where("source_type = 'browser_capture'").groupBy("url").agg(F.max("id").alias("by_url")).withColumnRenamed("url", "s_url")
    rows = rows.join(ids.hint("merge"), rows["source.id"] == ids["by_id"], "left").join(urls.hint("merge"), rows["page.url"] == urls["s_url"], "left")
    named = F.filter("jobs", lambda j: ~blank(squeeze(j["company"])))
    company = squeeze(filled(F.col("source.company"), F.get(named, 0)["company"]))
    site = squeeze(filled(F.col("source.site"), F.col("page.site")))
    label = F.concat(
        F.lit("Capture: "),
        F.when(
            (company != "") & (site != ""), F.concat(company, F.lit(" ("), site, F.lit(")"))
        ).otherwise(filled(company, F.col("page.title"), site, F.lit("Captured postings")))
    )
    name = F.when(~blank(F.col("source.name")), squeeze(F.col("source.name"))).otherwise(label)
    rows = rows.select(
        F.coalesce("by_id", "by_url").alias("source_id"), F.col("page.url").alias("url"),
        F.when(F.coalesce("by_id", "by_url").isNull(), name).alias("new_name")
    )
    return rows.groupBy("source_id", "url").agg(F.min("new_name").alias("new_name"))
