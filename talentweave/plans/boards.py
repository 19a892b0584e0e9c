"""Queries over pages and files of job boards, put together from the parts' and suppliers' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators import boards, extract, listings
from talentweave.operators.annotate import best_salary
from talentweave.plans.derived import spread, table
from talentweave.plans.registry import chosen, query
from talentweave.sources import readers
from talentweave.sources.shared import shared_path


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k")


# ---- structured data in pages --------------------------------------------------------------------------------
_PLACES = [
    '{"address": {"addressLocality": "Oslo", "addressCountry": "NO"}}',
    '[{"address": {"addressLocality": "Rome"}}, {"name": "Remote"}]', '"Anywhere"', '{"name": "Harbour"}'
]
_PAY = [
    '"baseSalary": {"currency": "USD", "value": {"minValue": 20, "maxValue": 30.5, "unitText": "HOUR"}},',
    '"baseSalary": {"currency": "EUR", "value": {"value": 50000, "unitText": "YEAR"}},', ""
]
_JOB = f"""concat('{{"@type": "JobPosting", "title": "Job ', k, '", "identifier": {{"value": "', k, '"}}, "url": "/j/', k, '", {chr(34)}hiringOrganization{chr(34)}: {{"name": "Firm ', k % 9, '"}}, ', {chosen('k', _PAY)}, ' "jobLocation": ', {chosen('k', _PLACES)}, ', "description": "<b>Do</b> it"}}')"""


def _jsonld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as an object, in a list, or in a graph; every fifth page has a broken block besides."""
    body = f"CASE k % 3 WHEN 0 THEN job WHEN 1 THEN concat('[', job, ', {{\"@type\": \"Person\"}}]') ELSE concat('{{\"@graph\": [', job, ']}}') END"
    html = F.expr(
        f"concat('<html><head>', CASE WHEN k % 5 = 0 THEN '<script type=\"application/ld+json\">{{broken</script>' ELSE '' END, '<script type=\"application/ld+json\">', {body}, '</script></head><body></body></html>')"
    )
    return _parts(spark, sf_dir).withColumn("job", F.expr(_JOB)).select(
        F.col("k").alias("page_id"), F.lit("https://board.example/list").alias("url"), html.alias("html")
    )


@query(f"""SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS raw_id, 'Job ' || p_partkey AS title, 'Firm ' || p_partkey % 9 AS company, {chosen('p_partkey', ['Oslo, NO', 'Rome, Remote', 'Anywhere', 'Harbour'])} AS location,
'Do it' AS description, 'https://board.example/j/' || p_partkey AS url, {chosen('p_partkey', ['$20 - $30.50/hr', 'EUR 50,000/yr', ''])} AS salary_text FROM part""")
def jsonld_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.jsonld_postings(_jsonld_pages(spark, sf_dir)).select(
        "page_id", "raw_id", "title", "company", "location", "description", "url", "salary_text"
    )


# ---- next pages ----------------------------------------------------------------------------------------------
_NEXT = [
    '<link rel="next" href="/list?page=2">', '<a href="/x">First</a><a rel="next" href="?page=3">3</a>',
    '<a href="/a">Newer</a><a href="/older/1">Older</a>', '<a href="b" aria-label="Next Page">&gt;</a>',
    '<a href="/next-level">Level up</a>'
]


@query(f"SELECT s_suppkey AS page_id, {chosen('s_suppkey', ['https://x.example/list?page=2', 'https://x.example/jobs/all?page=3', 'https://x.example/older/1', 'https://x.example/jobs/b', None])} AS next_url FROM supplier WHERE s_suppkey % 5 <> 4")
def page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.lit("https://x.example/jobs/all").alias("url"),
        F.expr(f"concat('<html><body>', {chosen('s_suppkey', _NEXT)}, '</body></html>')").alias("html")
    )
    return extract.next_page(rows)


# ---- cards and details, by the layouts of the boards -----------------------------------------------------------
_CARDS = {
    "indeed": """concat('<div data-jk="', k, '"><h2><a href="/rc/clk?jk=', k, '">Cook ', name, '</a></h2><span class="companyName">Diner</span><div class="companyLocation">Oslo</div><div class="job-snippet">Cook <b>well</b></div><div class="salary-snippet">$20 - $', 21 + k % 9, ' an hour</div><div class="metadata">Full-time</div><span class="date">Today</span></div>')""",
    "clearance": """concat('<div class="job-search-list-item-desktop"><a class="job-search-list-item-desktop__job-name" href="/jobs/', k, '">Guard ', name, '</a><span class="job-search-list-item-desktop__company-name">Fort</span><span class="job-search-list-item-desktop__location">Base</span><p class="job-search-list-item-desktop__description">Stand there.</p><div class="job-search-list-item-desktop__footer"><div><div>Secret</div><div>Base</div><div>Full-time</div></div><div><div>Posted today</div><div>$50,000 - $60,000 per year</div></div></div></div>')""",
    "generic": """concat('<ul><li><a href="/careers/', k, '">Clerk ', name, '</a><span class="company">Office</span><span class="location">Bern</span><p>File things</p><span class="salary">$30 per hour pay</span></li><li><a href="/about">About our firm</a></li></ul>')""",
}


def _card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout, url = F.expr(chosen("k", list(_CARDS))), F.expr(
        chosen("k", ["https://www.indeed.com/jobs", "https://www.clearancejobs.com/jobs", "https://firm.example/careers"])
    )
    card = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_CARDS.values()))
    return _parts(spark, sf_dir).select(
        F.col("k").alias("page_id"), url.alias("url"), layout.alias("layout"),
        F.expr(f"concat('<html><body><a href=\"/help\">Help</a>', CASE k % 3 {card} END, '</body></html>')").alias("html")
    )


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '/jobs/' || p_partkey ELSE '/careers/' || p_partkey END AS raw_id,
CASE p_partkey % 3 WHEN 0 THEN 'Cook ' WHEN 1 THEN 'Guard ' ELSE 'Clerk ' END || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'Diner' WHEN 1 THEN 'Fort' ELSE 'Office' END AS company, CASE p_partkey % 3 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'Base' ELSE 'Bern' END AS location,
CASE p_partkey % 3 WHEN 0 THEN 'Cook well' WHEN 1 THEN 'Stand there.' ELSE 'File things' END AS summary, CASE p_partkey % 3 WHEN 1 THEN 'Stand there. | Secret | Full-time | $50,000 - $60,000 per year' ELSE '' END AS requirements_text,
CASE p_partkey % 3 WHEN 0 THEN '$20 - $' || (21 + p_partkey % 9) || ' an hour' WHEN 1 THEN '$50,000 - $60,000 per year' ELSE '$30 per hour pay' END AS salary_text, CASE p_partkey % 3 WHEN 1 THEN 'Full-time' ELSE '' END AS employment_text,
CASE p_partkey % 3 WHEN 0 THEN 'https://www.indeed.com/rc/clk?jk=' || p_partkey WHEN 1 THEN 'https://www.clearancejobs.com/jobs/' || p_partkey ELSE 'https://firm.example/careers/' || p_partkey END AS url, CASE p_partkey % 3 WHEN 0 THEN 'Today' WHEN 1 THEN 'Posted today' ELSE '' END AS posted_at FROM part""")
def board_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.cards(_card_pages(spark, sf_dir)).drop("pos", "description")


_DETAILS = {
    "clearance": """concat('<h1 class="job-view-header-content__top__job-name">Guard ', name, '</h1><h2 class="job-view-header-content__top__job-company"><a>Fort</a></h2><div class="job-info"><div class="job-fit__nonSkills--location"><span class="el-tag__content">Base</span></div><div class="job-fit__nonSkills--careerLevel"><span class="el-tag__content">Unspecified</span></div><div class="job-fit__nonSkills--required"><span class="el-tag__content">Secret clearance</span><span class="el-tag__content">Day shift</span></div><a class="salary-estimate-link">$70,000 to $80,000 per year</a></div><div class="job-description">Guard <i>all</i> gates</div><time>May 1</time>')""",
    "jsonld": """concat('<h1>Ignored</h1><script type="application/ld+json">{"@type": "JobPosting", "title": "Cook ', name, '", "identifier": "', k, '", "hiringOrganization": {"name": "Diner"}, "description": "Stir"}</script>')""",
    "generic": """concat('<title>Clerk ', name, '</title><div class="companyName">Office</div><div class="companyLocation">Bern</div><div id="jobDescriptionText">File <b>things</b></div><div id="jobDetailsSection"><div aria-label="Pay"><ul><li>$25 - $35 an hour</li></ul></div><div aria-label="Job type"><ul><li>Part-time</li><li>Contract</li></ul></div></div><span class="date">Today</span>')""",
}


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'Guard ' WHEN 1 THEN 'Cook ' ELSE 'Clerk ' END || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'Fort' WHEN 1 THEN 'Diner' ELSE 'Office' END AS company, CASE p_partkey % 3 WHEN 0 THEN 'Base' WHEN 1 THEN '' ELSE 'Bern' END AS location,
CASE p_partkey % 3 WHEN 0 THEN 'Guard all gates' WHEN 1 THEN 'Stir' ELSE 'File things' END AS description, CASE p_partkey % 3 WHEN 0 THEN '$70,000 to $80,000 per year' WHEN 1 THEN '' ELSE '$25 - $35 an hour' END AS salary_text,
CASE p_partkey % 3 WHEN 0 THEN 'Day shift' WHEN 1 THEN '' ELSE 'Part-time | Contract' END AS employment_text, CASE p_partkey % 3 WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'https://site.example/' || p_partkey END AS raw_id, 'https://site.example/' || p_partkey AS url,
CASE p_partkey % 3 WHEN 0 THEN 'May 1' WHEN 1 THEN '' ELSE 'Today' END AS posted_at FROM part""")
def board_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_DETAILS.values()))
    pages = _parts(spark, sf_dir).select(
        F.col("k").alias("page_id"), F.expr("concat('https://site.example/', k)").alias("url"),
        F.expr(chosen("k", ["clearance", "other", "other"])).alias("layout"),
        F.expr(f"concat('<html><body>', CASE k % 3 {body} END, '</body></html>')").alias("html")
    )
    return boards.details(pages).select(
        "page_id", "title", "company", "location", "description", "salary_text", "employment_text", "raw_id", "url", "posted_at"
    )


_PAYS = ["Full-time", "Unspecified", "$20 - $30 per hour", "$20 - $30 per hour | Contract | Overtime", "3 to 5 years"]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '$20 - $30 per hour' ELSE '' END AS best, CASE WHEN p_partkey % 2 = 0 THEN '$20 - $30 per hour' ELSE 'Full-time' END AS any_best FROM part")
def salary_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.when(F.col("k") % 2 == 0, F.array(*[F.lit(_PAYS[i]) for i in (0, 3, 2, 1)])).otherwise(F.array(F.lit(_PAYS[4]), F.lit(_PAYS[0])))
    return _parts(spark, sf_dir).select(
        F.col("k").alias("p_partkey"), best_salary(texts).alias("best"), best_salary(texts, readable=False).alias("any_best")
    )


# ---- landed files --------------------------------------------------------------------------------------------
def _landed(rows: DataFrame, name: str, text: str = "text") -> str:
    """Texts of (file, text) as files of their own in one folder of the shared one; tasks put them in place themselves."""
    path = shared_path(rows.sparkSession, name)
    rows.select(text).write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
    return path


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's parts, each once, all of one supplier in one task."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("k"))
    return spread(rows, "file", 200_000).distinct()


_PARTS_SHIPPED = "s AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS k FROM lineitem)"


@query(f"WITH {_PARTS_SHIPPED} SELECT 7::BIGINT AS source_id, CAST(k AS VARCHAR) AS raw_id, 'Part ' || k AS title, 'City ' || f AS location, 'Made & sold' AS description, 'https://b.example/' || k AS url, '2024-01-02' AS posted_at FROM s")
def board_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.struct(
        F.col("k").cast("string").alias("id"), F.concat(F.lit("Part "), "k").alias("title"),
        F.concat(F.lit("https://b.example/"), "k").alias("absolute_url"), F.lit("2024-01-02").alias("updated_at"),
        F.lit("<p>Made &amp; sold</p>").alias("content"),
        F.struct(F.concat(F.lit("City "), "file").alias("name")).alias("location")
    )
    files = _shipped(spark, sf_dir).groupBy("file").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("text"))
    rows = readers.board_payloads(spark, _landed(files, "boards"), 7)
    return rows.select("source_id", "raw_id", "title", "location", "description", "url", "posted_at")


@query(f"WITH {_PARTS_SHIPPED} SELECT CAST(k AS VARCHAR) AS raw_id, 'Part ' || k AS title, 'City ' || f AS location, 'Needs hands' || chr(10) || 'Offers pay' AS requirements_text, 'contract' AS employment_text, '1700000000000' AS posted_at FROM s")
def postings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.expr("array(named_struct('text', 'Needs', 'content', '<li>hands</li>'), named_struct('text', 'Offers', 'content', '<li>pay</li>'))")
    posting = F.struct(
        F.col("k").cast("string").alias("id"), F.concat(F.lit("Part "), "k").alias("text"),
        F.lit(1700000000000).alias("createdAt"),
        F.struct(F.concat(F.lit("City "), "file").alias("location"), F.lit("contract").alias("commitment")).alias("categories"),
        told.alias("lists")
    )
    files = _shipped(spark, sf_dir).groupBy("file").agg(F.to_json(F.collect_list(posting)).alias("text"))
    rows = readers.postings_payloads(spark, _landed(files, "postings"), 7)
    return rows.select("raw_id", "title", "location", "requirements_text", "employment_text", "posted_at")


_SITE = "https://www.indeed.com/jobs?q="


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.struct(
        F.col("k").cast("string").alias("raw_id"), F.concat(F.lit(" Part  "), "k").alias("title"),
        F.when(F.col("k") % 2 == 0, "Maker").alias("company"), F.lit("<b>good</b> work").alias("summary")
    )
    page = F.struct(F.concat(F.lit(_SITE), F.col("file") % 9).alias("url"), F.lit("Jobs").alias("title"), F.lit("Site").alias("site"))
    source = F.struct(F.when(F.col("file") % 3 == 0, F.col("file")).alias("id"))
    files = _shipped(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    files = files.select("file", F.to_json(F.struct(F.lit("list").alias("parser"), page.alias("page"), source.alias("source"), "jobs")).alias("text"))
    return readers.captures(spark, _landed(files, "captures"))


@query(f"WITH {_PARTS_SHIPPED} SELECT CASE WHEN f % 3 = 0 THEN f END AS source_id, CAST(k AS VARCHAR) AS raw_id, 'Part ' || k AS title, CASE WHEN k % 2 = 0 THEN 'Maker' ELSE '' END AS company, 'good work' AS summary, 'https://www.indeed.com/viewjob?jk=' || k AS url, 'list' AS capture_parser FROM s")
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.capture_rows(_captured(spark, sf_dir)).select("source_id", "raw_id", "title", "company", "summary", "url", "capture_parser")


@query(f"""WITH {_PARTS_SHIPPED}, b AS (SELECT f, '{_SITE}' || f % 9 AS url, coalesce(first('Maker' ORDER BY k) FILTER (k % 2 = 0), '') AS company FROM s GROUP BY f),
r AS (SELECT CASE WHEN f % 3 = 0 AND f % 2 = 0 THEN f WHEN f % 9 < 4 THEN 1000 + f % 9 END AS source_id, url, 'Capture: ' || CASE WHEN company <> '' THEN 'Maker (Site)' ELSE 'Jobs' END AS name FROM b)
SELECT source_id, url, min(CASE WHEN source_id IS NULL THEN name END) AS new_name FROM r GROUP BY source_id, url""")
def capture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known are even suppliers by id and the pages of four searches by URL."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("id"), F.lit("https://other.example/").alias("url"), F.lit("custom_url").alias("source_type")
    )
    searches = spark.range(4).select(
        (F.col("id") + 1000).alias("id"), F.concat(F.lit(_SITE), "id").alias("url"), F.lit("browser_capture").alias("source_type")
    )
    return readers.resolve_sources(_captured(spark, sf_dir), known.unionByName(searches))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS number, CASE WHEN s_suppkey % 3 = 0 THEN 'too short' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 14 ELSE 64 END + length(CAST(s_suppkey AS VARCHAR)) AS n_chars FROM supplier")
def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("résumé\nof nr. "), F.col("s_suppkey"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.repeat(F.lit(" work"), F.lit(10)))
    )
    files = spread(table(spark, sf_dir, "supplier"), "s_suppkey", 2_000).select(F.col("s_suppkey").alias("file"), text.alias("text"))
    rows = readers.resume_texts(spark, _landed(files, "texts"))
    return rows.select(F.regexp_extract("text", r"nr\. (\d+)", 1).alias("number"), "status", (F.length("text") - 1).cast("long").alias("n_chars"))


# ---- lists and their pages -----------------------------------------------------------------------------------
@query("""WITH l AS (SELECT l_suppkey AS source_id, l_partkey % 40 AS raw, min(l_orderkey) AS pos FROM lineitem WHERE l_partkey % 40 > 0 GROUP BY ALL)
SELECT source_id, raw AS raw_id, pos FROM l""")
def page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one raw id on a page count once; those without a title not at all."""
    raw = (F.col("l_partkey") % 40).cast("string")
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("k"),
        (F.col("l_partkey") % 40).cast("string").alias("raw_id")
    ).agg(F.min("l_orderkey").alias("pos"))
    rows = rows.withColumns(
        {
            "page": F.lit(1), "url": F.lit(None).cast("string"), "company": F.lit("C"),
            "title": F.when(F.col("raw_id") == "0", "").otherwise(F.concat(F.lit("Part "), "k"))
        }
    )
    return listings.dedupe_page(rows).select("source_id", F.col("raw_id").cast("long").alias("raw_id"), "pos")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS source_id, l_linenumber AS page, l_orderkey AS k FROM lineitem WHERE NOT (l_linenumber = 2 + l_suppkey % 4)),
f AS (SELECT DISTINCT l_suppkey AS source_id, unnest(range(1, 8)) AS page FROM lineitem),
e AS (SELECT f.source_id, min(f.page) AS stop FROM f ANTI JOIN l ON l.source_id = f.source_id AND l.page = f.page GROUP BY f.source_id)
SELECT l.source_id, count(*) AS n, max(page) AS last_page FROM l LEFT JOIN e ON e.source_id = l.source_id WHERE (stop IS NULL OR page < stop) AND page <= 5 GROUP BY l.source_id""")
def empty_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("k")
    ).distinct()
    fetched = rows.select("source_id").distinct().select("source_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    got = listings.empty_stop(rows.where("page <> 2 + source_id % 4"), fetched, 5)
    return got.groupBy("source_id").agg(F.count("*").alias("n"), F.max("page").alias("last_page"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'better' ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 'told' ELSE 'listed' END AS description FROM part")
def detail_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _parts(spark, sf_dir).select("k", F.col("name").alias("title"), F.lit("listed").alias("description"))
    found = listed.select(
        "k", F.when(F.col("k") % 3 == 0, "better").otherwise("").alias("title"),
        F.when(F.col("k") % 5 == 0, "told").alias("description")
    )
    return listings.override(listed, found, ["k"], ["title", "description"])


@query("SELECT l_suppkey AS batch, CAST(arg_min(l_partkey, l_orderkey * 8 + l_linenumber) AS VARCHAR) AS company FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY l_suppkey")
def first_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("batch"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey").cast("string")).otherwise("").alias("company")
    )
    return listings.first_company(rows, ["batch"])


# ---- discovery -----------------------------------------------------------------------------------------------
@query("""SELECT 'q' || s_suppkey AS query, CASE s_suppkey % 3 WHEN 0 THEN 'https://jobs.lever.co/acme' || s_suppkey ELSE 'https://s' || s_suppkey || '.example/careers' END AS board_url,
CASE s_suppkey % 3 WHEN 0 THEN 'lever' ELSE 'careers page' END AS platform, 1 AS rank FROM supplier WHERE s_suppkey % 3 < 2""")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds whose career pages lead to a board, have none, or lead nowhere."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    home = s.select(
        (F.col("k") * 2).alias("page_id"), F.expr("concat('https://s', k, '.example/')").alias("url"),
        F.expr(
            "CASE WHEN k % 3 < 2 THEN '<a href=\"/careers\">Careers</a><a href=\"https://linkedin.com/x\">in</a>' ELSE '<a href=\"/about\">About</a>' END"
        ).alias("html")
    )
    careers = s.where("k % 3 < 2").select(
        (F.col("k") * 2 + 1).alias("page_id"), F.expr("concat('https://s', k, '.example/careers')").alias("url"),
        F.expr(
            "CASE WHEN k % 3 = 0 THEN concat('<a href=\"https://jobs.lever.co/acme', k, '/1\">One</a><a href=\"https://jobs.lever.co/acme', k, '/2\">Two</a>') ELSE '<p>Write to us</p>' END"
        ).alias("html")
    )
    seeds = s.select(F.expr("concat('q', k)").alias("query"), F.expr("concat('https://s', k, '.example/')").alias("url"))
    return extract.discover(home.unionByName(careers), seeds).select("query", "board_url", "platform", "rank")
