"""Queries over sources, scans, filters, terms and vectors, derived from the tables' keys."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.functions import urls
from talentweave.functions.dates import iso
from talentweave.functions.text import fold, squeeze
from talentweave.operators import annotate, extract, filters, matching, reports, sync, terms
from talentweave.plans import derived as d
from talentweave.plans.derived import table
from talentweave.plans.registry import AS_OF, chosen, query
from talentweave.sources import sinks

# ---- sources -------------------------------------------------------------------------------------------------
_URLS = [
    "https://boards.greenhouse.io/acme/jobs/1?gh_src=x", "https://jobs.lever.co/acme/2",
    "https://www.Indeed.com/jobs?q=a&l=b&from=x&vjk=7", "https://www.clearancejobs.com/jobs?page=2",
    "https://firm.example//careers/", "https://www.linkedin.com/jobs", "https://boards.greenhouse.io/embed/acme2",
    "https://shop.example/"
]
_TYPES = ["greenhouse", "lever", "indeed", "clearance", "custom_url", "custom_url", "greenhouse", "custom_url"]
_CLEAN = [
    "https://boards.greenhouse.io/acme/jobs/1", "https://jobs.lever.co/acme/2", "https://www.indeed.com/jobs?l=b&q=a",
    "https://www.clearancejobs.com/jobs?page=2", "https://firm.example/careers", "https://www.linkedin.com/jobs",
    "https://boards.greenhouse.io/embed/acme2", "https://shop.example/"
]
_LABELS = ["Greenhouse", "Lever", "Indeed", "Clearancejobs", "Firm", "Linkedin", "Greenhouse", "Shop"]
_IDS = ["acme", "acme", "jobs", "jobs", "careers", "jobs", "acme2", None]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), F.expr(chosen("s_suppkey", _URLS)).alias("url"), F.when(k % 11 == 0, "browser_capture").otherwise("auto").alias("source_type"), (k % 5 > 0).alias("enabled"),
        F.lit("e").alias("etag"), F.lit("m").alias("last_modified"), F.lit(dt.datetime(2024, 1, 1)).alias("last_scan_at"), F.lit("completed").alias("last_status"),
    )


_KIND = f"CASE WHEN s_suppkey % 11 = 0 THEN 'browser_capture' ELSE {chosen('s_suppkey', _TYPES)} END"


@query(f"""SELECT s_suppkey AS id, {_KIND} AS kind, {chosen('s_suppkey', _CLEAN)} AS clean, {chosen('s_suppkey', _LABELS)} AS label, {chosen('s_suppkey', _IDS)} AS identifier, s_suppkey % 5 > 0 AND s_suppkey % 11 > 0 AS scannable,
s_suppkey % 11 = 0 OR s_suppkey % 8 = 2 OR s_suppkey % 13 = 0 AS manual, s_suppkey % 8 IN (2, 5) AS excluded, s_suppkey % 8 IN (0, 2, 3, 4, 5) AS careers FROM supplier""")
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(spark, sf_dir)
    kind, url = urls.source_type(F.col("source_type"), F.col("url")), F.col("url")
    held = filters.scannable(rows).select("id", F.lit(True).alias("scannable"))
    flags = rows.select(
        "id", kind.alias("kind"), urls.source_url(url, kind).alias("clean"), urls.host_label(url).alias("label"),
        urls.board_identifier(url).alias("identifier"), filters.manual_assist(kind, F.col("id") % 13 == 0).alias("manual"),
        filters.excluded_host(url).alias("excluded"), filters.careers_path(url).alias("careers")
    )
    return flags.join(held.hint("merge"), "id", "left").withColumn("scannable", F.coalesce("scannable", F.lit(False)))


@query(f"SELECT s_suppkey AS id, s_suppkey % 8 = 5 AND s_suppkey % 11 > 0 AS rejected, {chosen('s_suppkey', _CLEAN)} AS url FROM supplier")
def saved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved, rejected = filters.split_supported(_sources(spark, sf_dir))
    return saved.select("id", F.lit(False).alias("rejected"), "url").unionByName(rejected.select("id", F.lit(True).alias("rejected"), "url"))


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'completed' END AS last_status, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END AS last_scan_at, 'e' AS etag FROM supplier")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(spark, sf_dir)
    results = rows.where("id % 2 = 0").select(
        F.col("id").alias("source_id"), F.lit(AS_OF).alias("last_scan_at"), F.lit("new").alias("last_status"),
        F.lit(None).cast("string").alias("etag")
    )
    return sync.scan_state(rows, results).select("id", "name", "last_status", "last_scan_at", "etag")


@query("SELECT s_suppkey + 10000 * CAST(s_suppkey % 3 = 0 AS INT) AS id, CASE WHEN s_suppkey % 3 > 0 THEN CASE WHEN s_suppkey % 3 = 1 THEN 'changed' ELSE s_name END ELSE 'added' END AS name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def source_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(spark, sf_dir).select("id", "name")
    changes = rows.select(
        (F.col("id") + F.when(F.col("id") % 3 == 0, 10000).otherwise(0)).alias("id"),
        F.when(F.col("id") % 3 == 0, "added").when(F.col("id") % 3 == 1, "changed").alias("name")
    )
    return sync.upsert(rows, changes)


@query("SELECT min(id) AS id, source_type, url FROM (SELECT max(s_suppkey) OVER (PARTITION BY s_suppkey % 8, s_suppkey % 11 = 0) AS id, " + f"CASE WHEN s_suppkey % 11 = 0 THEN 'browser_capture' ELSE 'auto' END AS source_type, {chosen('s_suppkey', _URLS)} AS url FROM supplier) GROUP BY source_type, url")
def sources_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.source_by_url(filters.ordered_sources(_sources(spark, sf_dir))).select("id", "source_type", "url")


@query("SELECT 'sources' AS what, count(*) AS n, count(*) AS n_null FROM supplier UNION ALL SELECT 'postings', 0, 0 UNION ALL SELECT 'scans', 0, 0")
def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = d.postings(spark, sf_dir)
    held = sync.cleared(postings, postings.select("id"), _sources(spark, sf_dir))
    gone = F.col("etag").isNull() & F.col("last_modified").isNull() & F.col("last_scan_at").isNull() & F.col("last_status").isNull()
    parts = [
        x.agg(
            F.count("*").alias("n"), F.count_if(gone if name == "sources" else F.lit(True)).alias("n_null")
        ).select(F.lit(name).alias("what"), "n", "n_null") for name,
        x in zip(("postings", "scans", "sources"), held, strict=True)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH p AS ({d.POSTINGS_SQL}) SELECT id, source_id FROM p WHERE source_id NOT IN (0, 2, 4, 6)")
def without_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = spark.range(0, 7, 2)
    return sync.without_sources(d.postings(spark, sf_dir), removed).select("id", "source_id")


# ---- scans ---------------------------------------------------------------------------------------------------
@query("""SELECT s_suppkey AS source_id, CASE s_suppkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'error' WHEN 2 THEN 'blocked' ELSE 'running' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey WHEN s_suppkey % 4 < 3 THEN 0 END AS jobs_found,
CASE s_suppkey % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'asks who' END AS error_text, CASE WHEN s_suppkey % 4 < 3 THEN TIMESTAMP '2024-01-31' END AS finished_at FROM supplier""")
def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that begin, and are closed with what came of them; every fourth still runs."""
    log = sinks.begin_scans(_sources(spark, sf_dir), dt.datetime(2024, 1, 30))
    k = F.col("source_id")
    done = log.where("source_id % 4 < 3").select(
        "id", F.expr(chosen("source_id", ["completed", "error", "blocked", "x"])).alias("status"),
        F.when(k % 4 == 0, k).alias("jobs_found"), F.when(k % 4 == 1, "failed").when(k % 4 == 2, "asks who").alias("error_text")
    )
    unknown = spark.range(1).select(
        (F.col("id") - 1).alias("id"), F.lit("x").alias("status"), F.lit(9).cast("long").alias("jobs_found"),
        F.lit("y").alias("error_text")
    )
    return sinks.finish_scans(log, done.unionByName(unknown), AS_OF).select("source_id", "status", "jobs_found", "error_text", "finished_at")


_STATES = ["completed", "error", "blocked", "cancelled"]


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 > 0 THEN 'Cancelled before completion.' WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN 'told'
ELSE o_orderkey % 9 || ' job(s) across ' || o_orderkey % 5 || ' page(s); ' || o_orderkey % 7 || ' detail page(s)' || CASE WHEN o_orderkey % 2 = 0 THEN '; stopped early after mostly-known pages' ELSE '' END END AS note FROM orders""")
def scan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.expr(chosen("o_orderkey", _STATES)).alias("status"),
        F.when((k % 3 == 0) & (k % 4 > 0), "told").otherwise("").alias("error_text"), (k % 9).alias("jobs_found"),
        (k % 5).alias("pages_scanned"), (k % 7).alias("detail_pages_fetched"), (k % 2 == 0).alias("stopped_early")
    )
    return rows.select("id", reports.scan_note().alias("note"))


@query(f"""WITH p AS ({d.POSTINGS_SQL}) SELECT count(*) AS n_cached, least(count(*) FILTER (application_confirmation_needed), 6) AS n_pending, count(*) FILTER (id % 3 = 0) AS n_matched, count(*) FILTER (id % 3 > 0) AS n_unmatched,
(SELECT count(*) FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 11 > 0) AS n_scannable, (SELECT count(*) FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 8 = 2) AS n_manual, TIMESTAMP '2024-01-01' AS last_scan_at FROM p""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = d.postings(spark, sf_dir)
    found = postings.where("id % 3 = 0").select(F.col("id").alias("posting_id"))
    return reports.dashboard(postings, found.unionByName(found), _sources(spark, sf_dir))


# ---- postings ------------------------------------------------------------------------------------------------
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(6).select("id", F.concat(F.lit("S"), "id").alias("name"), F.lit("custom_url").alias("source_type"))


@query(f"WITH p AS ({d.POSTINGS_SQL}) SELECT id, 'S' || source_id AS source_name FROM p WHERE source_id < 6")
def newest_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.newest_postings(d.postings(spark, sf_dir), _names(spark, sf_dir)).select("id", "source_name")


@query(f"WITH p AS ({d.POSTINGS_SQL}) SELECT id, 'S' || source_id AS source_name, company FROM p WHERE id = 7 AND source_id < 6")
def posting_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.posting_by_id(d.postings(spark, sf_dir), _names(spark, sf_dir), 7).select("id", "source_name", "company")


@query(f"WITH p AS ({d.POSTINGS_SQL}) SELECT id, CASE WHEN id % 4 = 1 THEN 'remote' WHEN id % 4 = 2 THEN 'hybrid' ELSE 'unknown' END AS remote_mode FROM p WHERE id % 4 = 1")
def filter_orders_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.postings(spark, sf_dir).withColumn(
        "remote_mode", F.expr("CASE WHEN id % 4 = 1 THEN 'remote' WHEN id % 4 = 2 THEN 'hybrid' ELSE 'unknown' END")
    )
    return filters.filter_postings(rows, remote_mode="remote").select("id", "remote_mode")


@query(f"""WITH p AS ({d.POSTINGS_SQL}) SELECT id, lower(replace(company, '  ', ' ')) AS company, 'contract | $5' AS terms, CASE WHEN id % 2 = 0 THEN 'Remote' ELSE 'Unknown' END AS mode,
CASE application_status WHEN 'applied' THEN 'Applied' WHEN 'pending' THEN 'Pending' ELSE 'Not applied' END AS state, round_even(id % 101, 0)::INT || '%' AS score_text FROM p""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.postings(spark, sf_dir).withColumns(
        {
            "profile_id": F.lit(1), "posting_id": F.col("id"), "title": F.lit("T"), "job_type": F.lit("contract"),
            "salary_text": F.lit("$5"), "remote_mode": F.when(F.col("id") % 2 == 0, "remote").otherwise("unknown"),
            "score": (F.col("id") % 101) / 100
        }
    )
    return reports.result_rows(rows).select(
        F.col("posting_id").alias("id"), F.lower("company").alias("company"), "terms", "mode", "state", "score_text"
    )


_LINKS = ["/jobs/1", "/Career/x", "/about", "/posting/9", "/opportunities"]
_TITLES = ["Cook", "Go", "Multiple openings today", "See all", "Oversee allied"]


@query(f"""SELECT o_orderkey AS id, o_orderkey % 5 IN (0, 3, 4) AS job_like, o_orderkey % 5 IN (2, 3) AS bundled, o_orderkey % 4 = 0 AS placeholder, o_orderkey % 4 = 1 AS employment, o_orderkey % 4 = 2 AS cleared,
o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS needs_detail, o_orderkey % 3 = 0 AS challenge FROM orders""")
def card_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    word = F.expr(chosen("o_orderkey", ["Not specified", "Part-time", "TS/SCI", "Nothing"]))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.expr(chosen("o_orderkey", _LINKS)).alias("href"), F.expr(chosen("o_orderkey", _TITLES)).alias("title"),
        word.alias("word")
    )
    host = F.when(F.col("id") % 3 == 0, "https://www.clearancejobs.com/x").otherwise("https://a.example/x")
    detail = filters.capture_needs_detail(
        host, F.lit("$1"), F.when(F.col("id") % 2 == 0, "short").otherwise(F.repeat(F.lit("long "), F.lit(60))), F.lit("all")
    )
    told = F.when(F.col("id") % 3 == 0, "Please wait. Just a  moment... Just a moment").otherwise("Open")
    return rows.select(
        "id", filters.job_like(F.col("href"), F.col("title")).alias("job_like"), filters.bundled(F.col("title")).alias("bundled"),
        annotate.placeholder(F.col("word")).alias("placeholder"), annotate.employment_fragment(F.col("word")).alias("employment"),
        annotate.clearance_token(F.col("word")).alias("cleared"), detail.alias("needs_detail"),
        annotate.challenge_page(told).alias("challenge")
    )


_MODES = ["Remote work", "A hybrid week", "On-site only", "In office", "Somewhere"]


@query(f"SELECT o_orderkey AS id, {chosen('o_orderkey', ['remote', 'hybrid', 'on-site', 'on-site', 'unknown'])} AS mode, {chosen('o_orderkey', ['full-time', 'contract', None])} AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 + o_orderkey % 9 END::DOUBLE AS years FROM orders")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = chosen("o_orderkey", ["Full time role", "1099 position", "A job"])
    text = F.expr(
        f"concat_ws(', ', {chosen('o_orderkey', _MODES)}, {kinds}, CASE WHEN o_orderkey % 2 = 0 THEN concat('1 year then ', 1 + o_orderkey % 9, '.5+ years') END)"
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))
    return rows.select(
        "id", annotate.work_mode(F.col("text")).alias("mode"), annotate.job_type(F.col("text")).alias("kind"),
        annotate.years_mentioned(F.col("text")).alias("years")
    )


@query(r"""SELECT doc_id, doc_id % 4 = 0 AS challenge, CASE WHEN doc_id % 3 = 0 THEN 'remote' WHEN doc_id % 3 = 1 THEN 'hybrid' ELSE 'unknown' END AS mode FROM documents""")
def doc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, some of them with a sentence that tells a work mode or asks for a check."""
    text = F.concat_ws(
        " ", "text", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Fully REMOTE.' WHEN doc_id % 3 = 1 THEN 'Hybrid week.' END"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN 'Ray ID: 1f' END")
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", annotate.challenge_page(F.col("text")).alias("challenge"), annotate.work_mode(F.col("text")).alias("mode"))


# ---- URLs ----------------------------------------------------------------------------------------------------
_RAW = [
    "https://www.indeed.com/jobs?q=a&vjk=v1&jk=j1", "/rc/clk?jk=j2&from=x", "", "https://Other.example/a//b/?utm_x=1&b=2&a=1#f",
    "https://duck.example/l/?uddg=https%3A%2F%2Fa.example%2Fx&rut=1"
]


@query(f"""SELECT o_orderkey AS id, {chosen('o_orderkey', ['v1', 'j2', '', '', ''])} AS job_id, {chosen('o_orderkey', ['https://www.indeed.com/viewjob?jk=v1', 'https://www.indeed.com/viewjob?jk=j2', 'https://www.indeed.com/viewjob?jk=r', 'https://other.example/a/b?a=1&b=2', 'https://duck.example/l?rut=1&uddg=https%3A%2F%2Fa.example%2Fx'])} AS url,
{chosen('o_orderkey', _RAW[:4] + ['https://a.example/x'])} AS target, CASE WHEN o_orderkey % 4 < 3 THEN 'https://b.example/list?page=' || (o_orderkey % 4 + 1) || '&q=x' END AS next_url FROM orders""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(chosen("o_orderkey", _RAW)).alias("raw"))
    page = F.lit("https://www.indeed.com/jobs")
    following = urls.next_page_url(F.lit("https://b.example/list?page=9&q=x"), (F.col("id") % 4).cast("int"), F.lit(3))
    return rows.select(
        "id", urls.board_job_id(F.col("raw")).alias("job_id"), urls.capture_url(F.col("raw"), page, F.lit("r")).alias("url"),
        urls.unwrap_redirect(F.col("raw")).alias("target"), following.alias("next_url")
    )


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS told FROM orders")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), iso(F.col("o_orderdate").cast("timestamp")).alias("told"))


_BOARDS = [
    "https://boards.greenhouse.io/acme/jobs/1", "https://jobs.lever.co/b/2?lever-source=x", "https://jobs.ashbyhq.com/c/3",
    "https://jobs.smartrecruiters.com/D/4", "https://jobs.jobvite.com/e/job/5", "https://f.workdayjobs.com/en/g/6",
    "https://g.bamboohr.com/careers/7", "https://h.example/careers/8", "https://i.example/about",
    "https://www.linkedin.com/jobs/9"
]
_PLATFORMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "jobvite", None, "bamboohr", "careers page", None, None]


@query(f"""SELECT o_orderkey AS id, {chosen('o_orderkey', ['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'jobvite', 'workday', 'bamboohr', 'careers page', 'x', 'x'])} AS platform,
{chosen('o_orderkey', ['https://boards.greenhouse.io/acme', 'https://jobs.lever.co/b', 'https://jobs.ashbyhq.com/c', 'https://jobs.smartrecruiters.com/D', 'https://jobs.jobvite.com/e/job', 'https://f.workdayjobs.com/en/g', 'https://g.bamboohr.com/careers', 'https://h.example/careers/8', 'x', 'x'])} AS board_url,
{chosen('o_orderkey', ['acme', 'b', None, None, None, None, None, None, None, None])} AS identifier FROM orders WHERE o_orderkey % 10 < 8""")
def board_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link rules themselves, on links to every kind of board."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(chosen("o_orderkey", _BOARDS)).alias("url"))
    return extract.classify_links(links).select("id", "platform", "board_url", "identifier")


# ---- terms and skills ----------------------------------------------------------------------------------------
_MANY = [(f"Term {i}", f"w{i}x", "made", i) for i in range(300)] + [
    ("Road", "straße", "word", 300), ("License", "licence", "word", 301), ("License", "license", "word", 302),
    ("Dot", ".net", "word", 303), ("Two", "apache   license", "word", 304)
]


@query(r"""WITH f AS (SELECT doc_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') || ' w' || doc_id % 400 || 'x on strasse asp.net' || CASE WHEN doc_id % 2 = 0 THEN ' .net' ELSE '' END AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Dot' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])licen[cs]e([^a-z0-9]|$)') THEN 'License' END, 'Road', CASE WHEN doc_id % 400 < 300 THEN 'Term ' || doc_id % 400 END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])apache license([^a-z0-9]|$)') THEN 'Two' END], lambda x: x IS NOT NULL), ',') AS terms FROM f""")
def doc_terms_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More aliases than fit in one expression, so the lexicon is joined."""
    lexicon = spark.createDataFrame(_MANY, "canonical string, alias string, category string, ord int")
    text = F.concat("text", F.lit(" w"), F.col("doc_id") % 400, F.lit("x on Straße asp.net"), F.when(F.col("doc_id") % 2 == 0, " .NET").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    return terms.annotate_terms(rows, "text", lexicon, key="doc_id").select("doc_id", F.array_join("terms", ",").alias("terms"))


@query(r"""WITH f AS (SELECT item_id AS id, regexp_extract_all(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'), '[a-z0-9]+|[^a-z0-9]') AS w, 'x' AS t FROM benchmark
  UNION ALL SELECT doc_id, regexp_extract_all(replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), 'ß', 'ss'), '[a-z0-9]+|[^a-z0-9]'), 'd' FROM documents),
p AS (SELECT id, t, w[i] AS a, w[i + 2] AS b FROM f, unnest(range(1, len(w) - 1)) AS g(i) WHERE w[i + 1] = ' ' AND regexp_matches(w[i], '[a-z0-9]') AND regexp_matches(w[i + 2], '[a-z0-9]')),
l AS (SELECT DISTINCT a, b FROM p WHERE t = 'x'),
h AS (SELECT DISTINCT p.id, l.a FROM p JOIN l ON p.a = l.a AND p.b = l.b WHERE t = 'd'),
s AS (SELECT id, count(*) AS n, string_agg(a, ',' ORDER BY a) AS terms FROM h GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_terms, coalesce(terms, '') AS terms FROM documents LEFT JOIN s ON doc_id = id""")
def doc_terms_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon that grows with the tables: all pairs of words of the benchmark's texts, names of parts, numbers of orders."""
    words = F.regexp_extract_all(fold(squeeze(F.col("text"))), F.lit("[a-z0-9]+|[^a-z0-9]"), F.lit(0))
    pairs = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(
        F.explode(F.expr("transform(sequence(1, greatest(size(w) - 2, 1)), i -> struct(get(w, i - 1) AS a, get(w, i) AS gap, get(w, i + 1) AS b))")).alias("p")
    ).where("p.gap = ' ' and p.a rlike '[a-z0-9]' and p.b rlike '[a-z0-9]'")
    lexicon = pairs.select(F.col("p.a").alias("canonical"), F.concat_ws(" ", "p.a", "p.b").alias("alias"))
    for name, column in (("part", F.concat(F.lit("Part of the name "), "p_name")), ("orders", F.concat(F.lit("order no. "), "o_orderkey"))):
        lexicon = lexicon.unionByName(table(spark, sf_dir, name).select(column.alias("canonical"), column.alias("alias")))
    rows = terms.annotate_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lexicon, key="doc_id")
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", ",").alias("terms"))


@query("SELECT DISTINCT l || k AS \"left\", r || k AS \"right\" FROM (SELECT 'nr' || (1000 + s_suppkey) AS k, unnest(['Python ', 'Amazon Web Services ', 'machine learning ']) AS l, unnest(['python ', 'AWS ', 'machine learning models ']) AS r FROM supplier)")
def skill_pairs_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alike by folding, by a lexicon's aliases, and by their words; others are not paired."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nr"), F.col("s_suppkey") + 1000).alias("k"))
    names = lambda *x: s.select(F.explode(F.array(*[F.concat(F.lit(v), "k") for v in x])).alias("name"))
    lexicon = s.select(
        F.concat(F.lit("Amazon Web Services "), "k").alias("canonical"), F.concat(F.lit("aws "), "k").alias("alias"),
        F.lit("cloud").alias("category"), F.lit(1).alias("ord")
    )
    return terms.skill_pairs(
        names("Python ", "Amazon Web Services ", "machine learning ", "welding "),
        names("python ", "AWS ", "machine learning models ", "cooking "), lexicon
    )


# ---- vectors and ranking -------------------------------------------------------------------------------------
@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 64 END AS n, CASE WHEN vec_id % 3 = 0 THEN length('text ' || vec_id) ELSE round(embedding[1]::DOUBLE, 4) END::DOUBLE AS first FROM embeddings")
def encode_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row has no vector and gets one (here of its text's length); the others keep theirs."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.col("embedding").cast("array<double>")).alias("embedding"),
        F.concat(F.lit("text "), "vec_id").alias("summary_text")
    )
    got = matching.encode(rows, encoder=lambda texts: np.stack([texts.str.len(), texts.str.len()], axis=1).astype(float))
    return got.select("id", F.size("embedding").alias("n"), F.round(F.get("embedding", 0), 4).alias("first"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS first, 'new' AS model FROM embeddings")
def vectors_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another model are taken anew."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    held = e.select("id", F.array(F.lit(1.0)).alias("embedding"), F.when(F.col("id") % 2 == 0, "new").otherwise("old").alias("model"))
    return sync.fill_vectors(
        held, e.select("id", F.array(F.lit(2.0)).alias("embedding")), model="new"
    ).select("id", F.get("embedding", 0).alias("first"), "model")


@query("""WITH p AS (SELECT vec_id % 50 = 0 AS mine, vec_id AS k FROM embeddings), r AS (SELECT k AS id FROM p WHERE NOT mine)
SELECT id, 'Semantic fit 50%.|Skill overlap 25%, 1 matched.|Experience 100%.|Matched: a.' || CASE WHEN id % 2 = 0 THEN '|Missing: b.' WHEN id % 3 = 0 THEN '|No skill gap.' ELSE '' END || CASE WHEN id % 5 = 0 THEN '|Needs clearance: Secret.' ELSE '' END || CASE WHEN id % 7 = 0 THEN '|Pay: $20 - $30/hr.' ELSE '' END AS reasons FROM r""")
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    k = F.col("id")
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"))
    rows = rows.withColumns(
        {
            "embedding_score": F.lit(0.5), "skill_score": F.lit(0.25), "experience_score": F.lit(1.0), "matched_skills": a("a"),
            "missing_skills": F.when(k % 2 == 0, a("b")).otherwise(a()), "required_skills": F.when(k % 3 == 0, a("a")),
            "matched_clearance": a(), "clearance_terms": F.when(k % 5 == 0, a("Secret")).otherwise(a()),
            "salary_text": F.when(k % 7 == 0, "$20 to $30 per hour").when(k % 7 == 1, "Full-time")
        }
    )
    return rows.select("id", F.array_join(matching.reasons(), "|").alias("reasons"))
