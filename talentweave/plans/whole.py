"""Queries over whole flows and records: ranking from raw postings to exports, stored indexes, captured pages, limits of lists.

Texts, pages and lists are those of the given tables, or differ by row; SQL works the answers out by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.functions.text import SCRIPT_NOISE, drop_noise, excerpt, lines, squeeze, text_hash
from talentweave.operators import extract, filters, listings, matching, normalize, profiles
from talentweave.plans import derived as d
from talentweave.plans.derived import spread, table
from talentweave.plans.registry import AS_OF, query
from talentweave.sources import readers, sinks
from talentweave.sources.shared import shared_path

# ---- records -------------------------------------------------------------------------------------------------
_SPACED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT doc_id, lang, coalesce(source, '') AS source, {_SPACED.format("coalesce(text, '')")} AS s FROM documents),
f AS (SELECT *, trim(substr(s, 1, 40)) AS title, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 239)) || '…' END AS summary FROM t)
SELECT doc_id, sha256(':' || title || ':' || source || ':') AS external_id, sha256({_SPACED.format("concat_ws(chr(10), title, source, lang, summary)")}) AS listing_hash,
  sha256(s) AS content_hash, summary, concat_ws(chr(10), nullif(title, ''), nullif(lang, '')) AS head FROM f""")
def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings without an id: their identity, their listing's and their content's hash, excerpt and head."""
    none, text = F.lit("").cast("string"), squeeze(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.alias("s"), F.substring(text, 1, 40).alias("title"))
    identity = normalize.external_id(F.lit(None).cast("long"), none, none, F.col("title"), F.col("source"), none)
    listing = normalize.listing_hash(F.col("title"), F.col("source"), F.col("lang"), excerpt(F.col("s")), none, none)
    return rows.select(
        "doc_id", identity.alias("external_id"), listing.alias("listing_hash"), text_hash(F.col("s")).alias("content_hash"),
        excerpt(F.col("s")).alias("summary"), lines(squeeze(F.col("title")), F.lit(None).cast("string"), F.col("lang")).alias("head")
    )


@query(rf"""WITH p AS (SELECT page_id, repeat('window.__state = {{}}; ', page_id % 4) || html AS t FROM pages)
SELECT page_id, CASE WHEN len(regexp_extract_all(substr(t, 1, 1200), '{SCRIPT_NOISE}')) >= 2 THEN 0 ELSE length(t) END::BIGINT AS n_kept FROM p""")
def page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with none to three script remains put before them; two or more in the first part make a text noise."""
    text = F.expr("concat(repeat('window.__state = {}; ', cast(page_id % 4 as int)), html)")
    return table(spark, sf_dir, "pages").select("page_id", F.length(drop_noise(text)).cast("long").alias("n_kept"))


@query("""WITH u AS (SELECT c_custkey AS id, c_nationkey AS owner, c_acctbal > 0 AS is_active, max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT owner, id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM u WHERE is_active) WHERE n = 1""")
def latest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles of their nations, updated by their last order; the last active one of each nation."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("updated_at"))
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), (F.col("c_acctbal") > 0).alias("is_active"))
    return filters.latest_active(rows.hint("merge").join(last, "id", "left")).select("owner", "id")


@query(f"""WITH {d.POSTINGS_SQL.strip().join(("p AS (", ")"))} SELECT source_id, external_id, sha256(description) AS content_hash, description, active, last_seen_at
FROM (SELECT *, true AS active FROM p)""")
def known_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of stored postings that a scan looks its listings up in."""
    none = F.lit(None).cast("string")
    rows = d.postings(spark, sf_dir).withColumns(
        {"content_hash": text_hash(F.col("description")), "listing_hash": none, "canonical_url": none, "employment_text": none, "salary_text": none}
    )
    return filters.known_index(rows).select("source_id", "external_id", "content_hash", "description", "active", "last_seen_at")


@query("""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=[a-z]+$', '') AS u FROM pages)
SELECT page_id FROM c WHERE u IN (SELECT u FROM c WHERE page_id % 3 = 0)""")
def pages_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a list of URLs, which carry other tracking keys and fragments than the pages' own."""
    pages = table(spark, sf_dir, "pages")
    more = F.when(F.col("url").contains("?"), "&").otherwise("?")
    urls = pages.where("page_id % 3 = 0").select(F.concat(F.regexp_replace("url", "#.*$", ""), more, F.lit("utm_campaign=spring#top")).alias("url"))
    return readers.pages_of(pages, urls).select("page_id")


@query("""SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'custom_url' END AS source_type, 'https://firm' || s_suppkey || '.example/jobs?page=' || s_suppkey % 4 AS url,
's' || s_suppkey AS identifier, true AS enabled, 180 AS refresh_minutes, 3 AS max_pages, 750 AS request_delay_ms, 'board of ' || s_nationkey || ': Found on page ' || s_suppkey AS notes FROM supplier WHERE s_suppkey % 10 > 0""")
def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found boards as sources to be stored; those without a URL are none."""
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://Firm"), k, F.lit(".example//jobs/?utm_source=feed&page="), k % 4, F.lit("#list"))
    found = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.when(k % 3 == 0, "greenhouse").when(k % 3 == 1, "lever").otherwise("custom_url").alias("source_type"),
        F.when(k % 10 > 0, url).alias("board_url"), F.concat(F.lit("s"), k).alias("identifier"),
        F.concat(F.lit("board of "), "s_nationkey").alias("platform"), F.concat(F.lit("Found on page "), k).alias("reason")
    )
    return extract.to_sources(found)


# ---- captured pages ------------------------------------------------------------------------------------------
def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as captures of an order's pages; a part seen twice in an order is one row."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("page_no"), F.col("l_quantity").alias("pos"), (F.col("l_partkey") % 3).cast("string").alias("raw_id"),
        F.lit("u").alias("url"), F.col("l_returnflag").alias("title"), F.lit(None).cast("string").alias("company"), F.col("l_linestatus").alias("location"), "l_suppkey", "l_shipdate"
    )


@query("""SELECT l_orderkey AS batch, CAST(l_partkey % 3 AS VARCHAR) AS raw_id, l_returnflag AS title, l_linestatus AS location, min(l_linenumber) AS page_no, count(*) > 0 AS found FROM lineitem GROUP BY ALL""")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings.merge_pages(_captures(spark, sf_dir))
    return rows.select("batch", "raw_id", "title", "location", "page_no", F.lit(True).alias("found"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS batch, arg_max(l_suppkey, l_linenumber) AS l_suppkey, arg_max(l_shipdate, l_linenumber) AS l_shipdate FROM p GROUP BY l_orderkey""")
def last_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last page of each capture says."""
    pages = _captures(spark, sf_dir).groupBy("batch", "page_no").agg(F.max("l_suppkey").alias("l_suppkey"), F.max("l_shipdate").alias("l_shipdate"))
    return listings.last_page_fields(pages, ["l_suppkey", "l_shipdate"])


# ---- ranking -------------------------------------------------------------------------------------------------
def _full_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as postings with all columns of stored ones; every third a second time under a later id; some not active."""
    k = F.col("id")
    text, when = (lambda v: F.lit(v).cast("string")), F.lit(AS_OF)
    rows = d.vector_postings(spark, sf_dir).withColumns({
        "source_id": (k % 5).cast("long"), "source_name": F.concat(F.lit("source "), k % 5), "company": F.concat(F.lit("Firm "), "label"), "location": F.concat(F.lit("Town "), k % 6),
        "remote_mode": F.when(k % 2 == 0, "remote").otherwise("onsite"), "job_type": text("contract"), "summary_text": F.concat(F.lit("Summary of "), k), "description": text("told"),
        "url": F.concat(F.lit("https://x.example/"), k), "canonical_url": text(None), "application_status": text(None), "application_confirmation_needed": F.lit(False), "active": k % 7 != 3,
        "posted_at": when, "last_seen_at": when, "last_updated_at": when, "first_seen_at": when, "clearance_terms": F.when(k % 4 == 0, F.array(F.lit("Secret"), F.lit("Polygraph"))).when(k % 4 == 1, F.array(F.lit("Polygraph"))).otherwise(F.array().cast("array<string>")),
    })
    return rows.unionByName(rows.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.when(F.col("profile_id") % 100 == 0, F.array(F.lit("POLYGRAPH"))).otherwise(F.array().cast("array<string>"))
    return d.vector_profiles(spark, sf_dir).withColumns({"summary_text": F.lit("me"), "clearance_terms": terms})


def _matches(spark: SparkSession, sf_dir: str, **given) -> DataFrame:
    return matching.rank_matches(_people(spark, sf_dir), _full_postings(spark, sf_dir), active_only=True, **given)


_WHOLE = f"""{d.RANK_SQL}, w AS (SELECT *, posting_id + CASE WHEN posting_id % 3 = 0 THEN 1000000 ELSE 0 END AS pid FROM z WHERE posting_id % 7 <> 3),
t AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, pid DESC) AS n FROM w WHERE (profile_id >= 0)),
m AS (SELECT *, list_filter(list_sort(list_distinct([req, pref])), lambda x: list_contains(ps, x)) AS ok, list_filter(list_sort(list_distinct([req, pref])), lambda x: NOT list_contains(ps, x)) AS ko,
  CASE posting_id % 4 WHEN 0 THEN ['Secret', 'Polygraph'] WHEN 1 THEN ['Polygraph'] ELSE [] END AS terms, posting_id % 4 < 2 AND profile_id % 100 = 0 AS cleared FROM t WHERE n <= 20),
x2 AS (SELECT *, list_filter(['Semantic fit ' || CAST(round_even(e * 100, 0) AS INT) || '%.', 'Skill overlap ' || CAST(round_even(s * 100, 0) AS INT) || '%, ' || len(ok) || ' matched.', 'Experience ' || CAST(round_even(xs * 100, 0) AS INT) || '%.',
  CASE WHEN len(ok) > 0 THEN 'Matched: ' || array_to_string(ok, ', ') || '.' END, CASE WHEN len(ko) > 0 THEN 'Missing: ' || array_to_string(ko, ', ') || '.' ELSE 'No skill gap.' END,
  CASE WHEN cleared THEN 'Clearance: Polygraph.' WHEN len(terms) > 0 THEN 'Needs clearance: ' || array_to_string(terms, ', ') || '.' END], lambda r: r IS NOT NULL) AS reasons FROM m)"""


@query(f"WITH {_WHOLE} SELECT profile_id, pid AS posting_id, CAST(n AS INT) AS rank, round(score, 6) AS score, CASE WHEN cleared THEN 'Polygraph' ELSE '' END AS common, array_to_string(reasons, ' | ') AS reasons FROM x2")
def ranked_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as stored, with copies and inactive ones: deduplicated, filtered, encoded, scored, ranked and explained."""
    common = F.array_join("matched_clearance", ",").alias("common")
    return _matches(spark, sf_dir).select("profile_id", "posting_id", "rank", F.round("score", 6).alias("score"), common, F.array_join("reasons", " | ").alias("reasons"))


@query(f"""WITH {_WHOLE.replace("(profile_id >= 0)", "posting_id % 6 = 2 AND posting_id % 4 < 2")} SELECT profile_id, pid AS posting_id, CAST(n AS INT) AS rank FROM x2""")
def ranked_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ranked_whole``, of one town and clearance."""
    rows = _matches(spark, sf_dir, location_query="town 2", clearance_terms=["polygraph"], job_type="contract")
    return rows.select("profile_id", "posting_id", "rank")


@query(f"""WITH {_WHOLE} SELECT 'posting ' || posting_id AS title, 'Firm ' || substr(req, 2) AS company, 'Town ' || posting_id % 6 AS location, CASE WHEN posting_id % 2 = 0 THEN 'remote' ELSE 'onsite' END AS remote_mode, 'contract' AS job_type, NULL::VARCHAR AS salary_text,
round(score, 4) AS score, round(e, 4) AS embedding_score, round(s, 4) AS skill_score, round(xs, 4) AS experience_score, array_to_string(ok, ', ') AS matched_skills, array_to_string(ko, ', ') AS missing_skills, array_to_string(reasons, ' | ') AS reasons,
'https://x.example/' || posting_id AS url, '2024-01-31T00:00:00' AS posted_at FROM x2""")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen columns, written as CSV and read back."""
    path = shared_path(spark, "export")
    sinks.write_csv(_matches(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    scores = {c: F.col(c).cast("double") for c in back.columns if c.endswith("score")}
    lists = {c: F.coalesce(c, F.lit("")) for c in ("matched_skills", "missing_skills")}
    return back.withColumns(scores | lists | {"posted_at": F.substring("posted_at", 1, 19)})


@query(f"""WITH {_WHOLE} SELECT pid AS id, posting_id % 5 AS source_id, 'source ' || posting_id % 5 AS source_name, 'posting ' || posting_id AS title, 'Summary of ' || posting_id AS summary_text, array_to_string(terms, ',') AS clearance, req AS required, pref AS preferred,
round(score, 6) AS score, len(reasons) AS n_reasons, '2024-01-31T00:00:00' AS posted_at FROM x2""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their posting inside, written as JSON and read back."""
    path = shared_path(spark, "export")
    sinks.write_json(_matches(spark, sf_dir), path)
    inner = ["id", "source_id", "source_name", "title", "summary_text"]
    lists = [F.array_join(f"job.{a}", ",").alias(b) for a, b in (("clearance_terms", "clearance"), ("required_skills", "required"), ("preferred_skills", "preferred"))]
    return spark.read.json(path).select(
        *[f"job.{c}" for c in inner], *lists, F.round("score", 6).alias("score"), F.size("reasons").alias("n_reasons"), F.substring("job.posted_at", 1, 19).alias("posted_at")
    )


@query("""SELECT vec_id + CASE WHEN vec_id % 3 = 0 THEN 1000000 ELSE 0 END AS id, vec_id % 2 = 0 AS remote FROM embeddings WHERE vec_id % 50 <> 0 AND vec_id % 7 <> 3 AND vec_id % 4 = 0""")
def browsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered view without ranking: active postings, each once, that ask for both clearances."""
    rows = matching.browse_postings(_full_postings(spark, sf_dir), clearance_terms=["secret", "polygraph"], active_only=True)
    return rows.select("id", (F.col("remote_mode") == "remote").alias("remote"))


# ---- limits of lists -----------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT c_custkey AS resume_id, 1 + c_custkey % 13 AS n FROM customer)
SELECT resume_id, least(n, 8) AS n_titles, least(n, 8) AS n_entries, 'Data Engineer ' || resume_id || 'x' || least(n, 8) AS last_title, 'Firm ' || least(n, 8) || ' of ' || resume_id AS last_company FROM c""")
def history_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumés of one to thirteen entries, all different: eight titles and eight entries stay, the first ones."""
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id")), "resume_id")
    rows = rows.select("resume_id", F.explode(F.expr("sequence(1, 1 + cast(resume_id % 13 as int))")).alias("i"))
    dated = F.concat(F.lit("Data Engineer "), "resume_id", F.lit("x"), "i", F.lit(" | Jan "), 2020 - F.col("i"), F.lit(" - Dec "), 2020 - F.col("i"))
    place = F.concat(F.lit("Duties at Firm "), "i", F.lit(" of "), "resume_id")
    rows = rows.select("resume_id", F.col("i").alias("i"), F.posexplode(F.array(dated, place)).alias("n", "line"))
    rows = rows.select("resume_id", (2 * F.col("i") + F.col("n")).alias("pos"), "line")
    history = profiles.work_history(rows, AS_OF.date()).groupBy("resume_id").agg(
        F.count("*").cast("int").alias("n_entries"), F.max_by("title", "n").alias("last_title"), F.max_by("company", "n").alias("last_company")
    )
    titles = profiles.recent_titles(rows).select("resume_id", F.size("titles").alias("n_titles"))
    return history.hint("merge").join(titles, "resume_id").select("resume_id", "n_titles", "n_entries", "last_title", "last_company")
