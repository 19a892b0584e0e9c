"""Registered queries over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentweave.functions.text import EMAIL, excerpt, first_match, fold, squeeze, strip_html, text_hash
from talentweave.functions.urls import TRACKING_KEYS, canonical_url
from talentweave.operators import annotate, bounds, dedupe, extract, filters, listings, matching, normalize, profiles, reports, state, sync, terms
from talentweave.plans import derived as d
from talentweave.plans.derived import table
from talentweave.plans.registry import AS_OF, QUERIES, SQL, query
from talentweave.sources.buckets import bucketed_scratch
from talentweave.sources.shared import shared_path
from talentweave.sources.sinks import flat
from talentweave.sources.snapshots import manifest, publish_sources, read_current
from talentweave.streaming import flows

# ---- pages -------------------------------------------------------------------------------------------------
_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)
_CANONICAL = rf"""
u AS (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, html, lower(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)) AS root, regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path, string_split(regexp_extract(u, '\?(.*)$', 1), '&') AS qs FROM u),
c AS (SELECT page_id, html, root || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(ks) = 0 THEN '' ELSE '?' || array_to_string(ks, '&') END AS canonical FROM (
  SELECT page_id, html, root, regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '/+$', '') AS p,
    list_sort(list_filter(qs, lambda x: regexp_extract(x, '=(.+)$', 1) <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(regexp_extract(x, '^([^=]*)=', 1)) NOT IN ({_KEYS}))) AS ks FROM q))
"""
_STRIPPED = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(f"WITH {_CANONICAL} SELECT page_id, canonical FROM c")
def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {_CANONICAL} SELECT canonical, arg_max(page_id, (length(html), page_id)) AS page_id, max(length(html)) AS n_html FROM c GROUP BY canonical")
def dedupe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", canonical_url(F.col("url")).alias("canonical"), F.length("html").cast("long").alias("n_html")
    )
    return dedupe.best_of(pages, F.col("canonical"), F.col("n_html"), F.col("page_id")).select("canonical", "page_id", "n_html")


@query(f"WITH t AS (SELECT page_id, {_STRIPPED.format(c='html')} AS t FROM pages) SELECT page_id, sha256(t) AS text_hash, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 119)) || '…' END AS excerpt FROM t")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select(
        "page_id", text_hash(F.col("t")).alias("text_hash"), excerpt(F.col("t"), 120).alias("excerpt")
    )


_LINKS = rf"""
u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract_all(html, '(?is)<a\b([^>]*)>(.*?)</a\s*>', 1) AS a, regexp_extract_all(html, '(?is)<a\b([^>]*)>(.*?)</a\s*>', 2) AS t FROM pages),
l AS (SELECT page_id, i - 1 AS pos, root || replace(regexp_extract(a[i], 'href\s*=\s*"([^"]*)"', 1), '&amp;', '&') AS url, {_STRIPPED.format(c='t[i]')} AS text FROM u, unnest(range(1, len(a) + 1)) AS g(i))
"""


@query(f"WITH {_LINKS} SELECT page_id, pos, url, text FROM l")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "text")


# no link here leads to a board, so the rules are others: paths by their first letter
_RULES = (("", "^/[a-f]", "early", "custom_url", 1, 0), ("", "^/[g-p]", "middle", "custom_url", 1, 1), ("", "^/[q-z]", "late", "custom_url", 0, 3))
_CLASSES = f"""
{_LINKS}, k AS (SELECT page_id, pos, url, lower(regexp_extract(url, '^[a-z]+://[^/]*/([a-zA-Z])', 1)) AS x FROM l),
m AS (SELECT page_id, pos, url, CASE WHEN x BETWEEN 'a' AND 'f' THEN 'early' WHEN x BETWEEN 'g' AND 'p' THEN 'middle' ELSE 'late' END AS platform, CASE WHEN x BETWEEN 'a' AND 'f' THEN 0 WHEN x BETWEEN 'g' AND 'p' THEN 1 ELSE 3 END AS priority FROM k WHERE x BETWEEN 'a' AND 'z')
"""


@query(f"WITH {_CLASSES} SELECT page_id, pos, platform, priority FROM m")
def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.classify_links(extract.extract_links(table(spark, sf_dir, "pages")), _RULES).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "platform", "priority"
    )


@query(f"""WITH {_CLASSES}, o AS (SELECT page_id, url, min_by(platform, pos) AS platform, min_by(priority, pos) AS priority FROM m GROUP BY page_id, url)
SELECT page_id, CAST(rank AS INT) AS rank, url AS board_url, platform FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority, url) AS rank FROM o) WHERE rank <= 10""")
def candidates_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.classify_links(extract.extract_links(table(spark, sf_dir, "pages")), _RULES)
    found = links.select(
        "page_id", "name", "source_type", "board_url", "platform", "priority", F.col("page_url").alias("reason"),
        F.col("pos").alias("seq")
    )
    return extract.best_candidates(found, ["page_id"]).select("page_id", "rank", "board_url", "platform")


# ---- documents ---------------------------------------------------------------------------------------------
_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_FOLDED = f"replace(lower({_SQUEEZED}), 'ß', 'ss')"


@query(f"SELECT sha256({_SQUEEZED}) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_LEXICON = [
    ("License", "license", "legal", 1), ("License", "licence", "legal", 2), ("Apache", "apache", "tool", 3),
    ("MIT", "mit", "tool", 4), ("And", "und", "word", 5), ("And", "and", "word", 6), ("The", "der", "word", 7),
    ("The", "the", "word", 8)
]
_TERMS = {"And": "und|and", "Apache": "apache", "License": "licence|license", "MIT": "mit", "The": "der|the"}
_TERM_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(t, '(^|[^a-z0-9])({p})([^a-z0-9]|$)') THEN '{n}' END" for n, p in _TERMS.items()
) + "], lambda x: x IS NOT NULL)"


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LEXICON, "canonical string, alias string, category string, ord int")


@query(f"WITH f AS (SELECT doc_id, {_FOLDED} AS t FROM documents) SELECT doc_id, array_to_string({_TERM_LIST}, ',') AS terms FROM f")
def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = terms.annotate_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _lexicon(spark), key="doc_id")
    return rows.select("doc_id", F.array_join("terms", ",").alias("terms"))


@query(f"WITH f AS (SELECT doc_id, {_FOLDED} AS t FROM documents) SELECT doc_id, array_to_string(list_filter({_TERM_LIST}, lambda x: x IN ('Apache', 'MIT')), ',') AS tools FROM f")
def doc_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = terms.annotate_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _lexicon(spark), key="doc_id")
    return rows.select("doc_id", F.array_join(terms.in_categories(F.col("terms"), {c: k for c, _, k, _ in _LEXICON}, ("tool",)), ",").alias("tools"))


@query(f"SELECT doc_id, nullif(regexp_extract(text, '{EMAIL}'), '') AS email FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def doc_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_match(F.col("text"), EMAIL).alias("email")).where("email is not null")


@query(r"""
WITH l AS (SELECT doc_id, i AS pos, trim(regexp_replace(string_split(text, chr(10))[i], '\s+', ' ', 'g')) AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS g(i)),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^[^ ]+$') THEN line END AS head FROM l WHERE line <> ''),
s AS (SELECT doc_id, pos, head, line, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'summary') AS section FROM h)
SELECT doc_id, section, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_hash FROM s WHERE head IS NULL GROUP BY doc_id, section""")
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.lines(table(spark, sf_dir, "documents"), key="doc_id")
    rows = profiles.sectioned(rows, F.when(F.col("line").rlike("^[^ ]+$"), F.col("line")))
    return rows.groupBy(F.col("resume_id").alias("doc_id"), "section").agg(
        F.count("*").alias("n_lines"), F.sha2(profiles.ordered_text(F.col("line"), F.col("pos")), 256).alias("text_hash")
    )


@query("""
WITH s AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment,
  last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answered FROM conversations)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, min(answered) AS answered FROM s GROUP BY conv_id, segment""")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("resume_id"), F.col("turn").alias("pos"), "role", "text")
    before = Window.partitionBy("resume_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = profiles.segments(rows, F.col("role") == "user").withColumn(
        "answered", F.last(F.when(F.col("role") == "assistant", F.col("pos")), ignorenulls=True).over(before)
    )
    return rows.groupBy(F.col("resume_id").alias("conv_id"), "segment").agg(
        F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.min("answered").alias("answered")
    )


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(lower(x), '(^|[^a-z])(with|mit|por|pour)([^a-z]|$)')) AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, sha256(array_to_string(s, chr(10))) AS text_hash FROM s WHERE len(s) > 0""")
def sentence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.filter(annotate.sentences(F.col("text")), lambda s: F.lower(s).rlike("(^|[^a-z])(with|mit|por|pour)([^a-z]|$)"))
    rows = table(spark, sf_dir, "documents").select("doc_id", told.alias("s")).where("size(s) > 0")
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("text_hash"))


@query("WITH u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY batch) AS n FROM (SELECT doc_id, source, 1 AS batch FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source, 2 AS batch FROM documents WHERE doc_id % 3 = 0)) SELECT doc_id, source, batch FROM u WHERE n = 1")
def union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    both = docs.where("doc_id % 2 = 0").withColumn("batch", F.lit(1)).unionByName(docs.where("doc_id % 3 = 0").withColumn("batch", F.lit(2)))
    return dedupe.keep_first(both, ["doc_id"], ["batch"])


# ---- parts: salary, skills ---------------------------------------------------------------------------------
@query("""SELECT p_partkey, p_retailprice AS low, p_retailprice + 50 AS high, 'hour' AS interval,
'$' || CASE WHEN p_retailprice >= 1000 THEN format('{:,}', CAST(round_even(p_retailprice, 0) AS BIGINT)) WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE format('{:.2f}', p_retailprice) END || ' - $' ||
CASE WHEN p_retailprice + 50 >= 1000 THEN format('{:,}', CAST(round_even(p_retailprice + 50, 0) AS BIGINT)) WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice + 50 AS BIGINT) AS VARCHAR) ELSE format('{:.2f}', p_retailprice + 50) END || '/hr' AS display FROM part""")
def salary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.format_number(c, 2)
    text = F.concat(F.lit("Pay: $"), money(F.col("p_retailprice")), F.lit(" - $"), money(F.col("p_retailprice") + 50), F.lit(" per hour"))
    rows = d.spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey").select("p_partkey", annotate.salary(text).alias("s"))
    return rows.select("p_partkey", "s.low", "s.high", "s.interval", "s.display")


_WORDS = "w AS (SELECT DISTINCT l_suppkey AS suppkey, unnest(string_split(p_name, ' ')) AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_WORDS}, a AS (SELECT DISTINCT name FROM w WHERE suppkey % 2 = 0), b AS (SELECT DISTINCT name FROM w WHERE suppkey % 2 = 1) SELECT a.name AS \"left\", b.name AS \"right\" FROM a JOIN b ON lower(a.name) = lower(b.name)")
def skill_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = d.part_words(spark, sf_dir)
    none = spark.createDataFrame([], "canonical string, alias string, category string, ord int")
    return terms.skill_pairs(words.where("suppkey % 2 = 0").select("name"), words.where("suppkey % 2 = 1").select("name"), none)


_SUPPLIERS = f"""{_WORDS}, s AS (SELECT suppkey, list_sort(list(name)) AS names FROM w GROUP BY suppkey),
m AS (SELECT suppkey, names, list_filter(names, lambda x: x < 'm') AS required, list_filter(names, lambda x: x >= 'm') AS preferred, list_filter(names, lambda x: length(x) % 2 = 0) AS have FROM s)"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.part_words(spark, sf_dir).groupBy("suppkey").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return s.withColumns(
        {
            "required": F.filter("names", lambda x: x < "m"), "preferred": F.filter("names", lambda x: x >= "m"),
            "have": F.filter("names", lambda x: F.length(x) % 2 == 0)
        }
    )


@query(f"""WITH {_SUPPLIERS}, n AS (SELECT suppkey, len(required) AS r, len(preferred) AS p, len(list_intersect(required, have)) AS rm, len(list_intersect(preferred, have)) AS pm FROM m)
SELECT suppkey, round(CASE WHEN r > 0 THEN 0.75 * (rm + 0.55 * pm) / (r + 0.55 * p) + 0.25 * rm / r ELSE pm * 1.0 / p END, 6) AS score FROM n""")
def skill_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = matching.weighted_skills(F.col("required"), F.col("preferred"), F.col("names"))
    return _suppliers(spark, sf_dir).select("suppkey", F.round(matching.skill_score(weighted, F.col("have"), F.size("have") > 0), 6).alias("score"))


@query(f"WITH {_SUPPLIERS} SELECT suppkey, array_to_string(list_filter(names, lambda x: length(x) % 2 = 1), ',') AS missing FROM m")
def missing_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    target = matching.target_skills(F.col("required"), F.col("preferred"), F.col("names"))
    return s.select("suppkey", F.array_join(F.array_except(target, "have"), ",").alias("missing"))


# ---- postings ----------------------------------------------------------------------------------------------
def _filtered(where: str) -> str:
    return f"WITH p AS ({d.POSTINGS_SQL}) SELECT id, source_id, location, job_type, application_status FROM p WHERE {where}"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "source_id", "location", "job_type", "application_status")


@query(_filtered("source_id IN (1, 3)"))
def filter_orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.filter_postings(d.postings(spark, sf_dir), source_ids=[1, 3], active_only=True))


@query(_filtered("contains(lower(location || ' ' || description), 'build')"))
def filter_orders_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.filter_postings(d.postings(spark, sf_dir), location_query="BUILD"))


@query(_filtered("job_type = '1-URGENT'"))
def filter_orders_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.filter_postings(d.postings(spark, sf_dir), job_type="1-URGENT"))


@query(_filtered("cleared = 0"))
def filter_orders_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.filter_postings(d.postings(spark, sf_dir), clearance_terms=["secret", "POLYGRAPH"]))


@query(_filtered("application_status IN ('not_applied', 'pending')"))
def filter_orders_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.filter_postings(d.postings(spark, sf_dir), state="not_applied_yet"))


@query(_filtered("application_status = 'pending' AND application_confirmation_needed"))
def filter_orders_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.filter_postings(d.postings(spark, sf_dir), state="pending"))


@query(f"WITH p AS ({d.POSTINGS_SQL}) SELECT id, source_id FROM p WHERE application_confirmation_needed ORDER BY last_seen_at DESC, id DESC LIMIT 6")
def pending_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pending_confirmation(
        d.postings(spark, sf_dir).withColumn("application_last_opened_at", F.col("last_seen_at"))
    ).select("id", "source_id")


_DEDUPE = f"""WITH p AS ({d.POSTINGS_SQL}), k AS (SELECT *, lower(company) || '|' || lower(location) || '|' || lower(job_type) AS key,
CASE WHEN application_confirmation_needed THEN 3 WHEN application_status = 'applied' THEN 2 ELSE 0 END AS pri FROM p)
SELECT key, arg_max(id, (pri, length(description), last_seen_at, id)) AS id, count(*) AS n FROM k GROUP BY key"""


@query(f"SELECT id FROM ({_DEDUPE})")
def dedupe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = d.postings(spark, sf_dir).withColumns(
        {
            "title": F.lit(""), "url": none, "canonical_url": none, "required_skills": F.lit(None).cast("array<string>"),
            "skills": F.lit(None).cast("array<string>"), "last_updated_at": F.col("last_seen_at"),
            "first_seen_at": F.col("last_seen_at")
        }
    )
    return dedupe.dedupe_postings(rows).select("id")


def _sync_sql(missing: str) -> str:
    return f"""WITH {d.SNAPSHOTS_SQL} SELECT coalesce(old.source_id, new.source_id) AS source_id, coalesce(old.external_id, new.external_id) AS external_id,
CASE WHEN old.h IS NULL THEN 'created' WHEN new.h IS NULL THEN '{missing}' WHEN old.h = new.h THEN 'unchanged' ELSE 'updated' END AS action
FROM old FULL JOIN new ON old.source_id = new.source_id AND old.external_id = new.external_id"""


@query(_sync_sql("deactivated"))
def sync_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.compare(d.old_snapshot(spark, sf_dir), d.new_snapshot(spark, sf_dir))


@query(_sync_sql("deactivated"))
def sync_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sync_full``, against a stored table in buckets, which the join reads where it lies."""
    return sync.compare(bucketed_scratch(d.old_snapshot(spark, sf_dir)), d.new_snapshot(spark, sf_dir))


@query(_sync_sql("kept"))
def sync_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.compare(d.old_snapshot(spark, sf_dir), d.new_snapshot(spark, sf_dir), deactivate_missing=False)


@query(f"SELECT source_id, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'deactivated') AS deactivated FROM ({_sync_sql('deactivated')}) GROUP BY source_id")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.counts(sync_full(spark, sf_dir))


@query(f"""WITH {d.SNAPSHOTS_SQL} SELECT new.source_id, new.external_id, coalesce(old.h = new.h, false) AS known_listing, coalesce(old.h <> new.h, true) AS needs_detail
FROM new LEFT JOIN old ON old.source_id = new.source_id AND old.external_id = new.external_id""")
def needs_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"description": F.lit("told"), "employment_text": F.lit(""), "salary_text": F.lit("")}
    known = d.old_snapshot(spark, sf_dir).withColumnRenamed("content_hash", "listing_hash").withColumns(texts)
    new = d.new_snapshot(spark, sf_dir).withColumnRenamed("content_hash", "listing_hash").withColumns(texts | {"description": F.lit("")})
    return listings.with_known(new, known).select("source_id", "external_id", "known_listing", "needs_detail")


@query(f"""WITH {d.SNAPSHOTS_SQL} SELECT new.source_id, new.external_id, coalesce(old.h = new.h, false) AS known_listing, coalesce(old.h <> new.h, true) AS needs_detail
FROM new LEFT JOIN old ON old.source_id = new.source_id AND old.external_id = new.external_id""")
def needs_detail_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"description": F.lit("told"), "employment_text": F.lit(""), "salary_text": F.lit("")}
    known = d.old_snapshot(spark, sf_dir).withColumnRenamed("content_hash", "listing_hash").withColumns(texts)
    new = d.new_snapshot(spark, sf_dir).withColumnRenamed("content_hash", "listing_hash").withColumns(texts | {"description": F.lit("")})
    return listings.with_known(new, known, prune=True).select("source_id", "external_id", "known_listing", "needs_detail")


_FIRST = f"WITH l AS ({d.LISTINGS_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY page, pos) AS n FROM l), g AS (SELECT * FROM f WHERE n = 1), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page, pos) AS m FROM g) WHERE m <= 120)"


@query(f"{_FIRST} SELECT source_id, page, pos, external_id FROM c")
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.cap(listings.dedupe_source(d.listings(spark, sf_dir))).select(
        "source_id", "page", F.col("pos").cast("long").alias("pos"), "external_id"
    )


@query(f"{_FIRST}, b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page, pos) AS k FROM c WHERE NOT known) SELECT source_id, page, pos, external_id FROM b WHERE k <= 10")
def detail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings.detail_budget(listings.cap(listings.dedupe_source(d.listings(spark, sf_dir))))
    return rows.select("source_id", "page", F.col("pos").cast("long").alias("pos"), "external_id")


_PAGES = f"""WITH l AS ({d.LISTINGS_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY page, pos) AS n FROM l), g AS (SELECT * FROM f WHERE n = 1),
p AS (SELECT source_id, page, count(*) AS n, count(*) FILTER (known) AS k FROM g GROUP BY source_id, page),
r AS (SELECT source_id, page, n, k, sum(CASE WHEN n >= 5 AND k / n >= 0.85 AND n - k <= greatest(1, n // 6) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run FROM p),
s AS (SELECT source_id, min(page) AS stop FROM r WHERE page >= 3 AND run = 2 GROUP BY source_id)"""


@query(f"{_PAGES} SELECT g.source_id, page, pos, external_id FROM g LEFT JOIN s ON g.source_id = s.source_id WHERE stop IS NULL OR page <= stop")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings.dedupe_source(d.listings(spark, sf_dir))
    rows = listings.early_stop(rows, listings.page_counts(rows, F.col("known")))
    return rows.select("source_id", "page", F.col("pos").cast("long").alias("pos"), "external_id")


@query(f"{_PAGES} SELECT source_id, page, n AS n_rows, k AS n_known FROM p")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.page_counts(listings.dedupe_source(d.listings(spark, sf_dir)), F.col("known"))


# ---- scans -------------------------------------------------------------------------------------------------
_SCANS = "s AS (SELECT o_orderkey AS id, o_custkey AS source_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'blocked' ELSE 'error' END AS status, o_orderkey % 11 AS created, o_orderkey % 5 AS updated, o_orderkey % 3 AS unchanged FROM orders)"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "blocked").otherwise("error")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"),
        (key % 11).alias("jobs_created"), (key % 5).alias("jobs_updated"), (key % 3).alias("jobs_unchanged"),
        (key % 11 + key % 5 + key % 3).alias("jobs_found"), F.lit(0).alias("jobs_deactivated")
    )


@query(f"WITH {_SCANS} SELECT id, coalesce(c_name, 'Source #' || source_id) AS source_name, status, '+' || created || ' / ~' || updated || ' / =' || unchanged AS change FROM s LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON source_id = c_custkey ORDER BY started_at DESC, id DESC LIMIT 25")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reports.recent_scans(_scans(spark, sf_dir), sources).select(
        "id", "source_name", "status",
        reports.change_text(F.col("jobs_created"), F.col("jobs_updated"), F.col("jobs_unchanged")).alias("change")
    )


@query(f"WITH {_SCANS} SELECT count(*) AS n_sources, sum(created + updated + unchanged)::BIGINT AS jobs_found, sum(created)::BIGINT AS jobs_created, sum(updated)::BIGINT AS jobs_updated, sum(unchanged)::BIGINT AS jobs_unchanged, 0::BIGINT AS jobs_deactivated, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'blocked') AS n_blocked, count(*) FILTER (status IN ('error', 'blocked')) AS n_issues FROM s")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_summary(_scans(spark, sf_dir))


@query(f"WITH {_SCANS} SELECT source_id, count(*) AS n_scans, sum(created)::BIGINT AS jobs_created, sum(updated)::BIGINT AS jobs_updated, sum(unchanged)::BIGINT AS jobs_unchanged, count(*) FILTER (status IN ('error', 'blocked')) AS n_issues FROM s GROUP BY source_id")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_totals(_scans(spark, sf_dir))


@query("SELECT user_id AS id, max(ts) AS last_scan_at FROM events GROUP BY user_id HAVING epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(ts))) >= 180 * 60")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_scan_at"))
    return filters.due_sources(sources, 180, AS_OF)


# ---- matching ----------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT vec_id AS profile_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0), j AS (SELECT vec_id AS posting_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE vec_id % 50 <> 0),
x AS (SELECT profile_id, posting_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a, b))), 6) AS score FROM p, j)
SELECT profile_id, posting_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posting_id DESC) AS rank FROM x) WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = {"embedding": 1.0, "skill": 0.0, "experience": 0.0}
    rows = matching.best_matches(d.vector_profiles(spark, sf_dir), d.vector_postings(spark, sf_dir), 10, weights=alone, order=("id",), digits=6)
    return rows.select(F.col("p_profile_id").alias("profile_id"), F.col("id").alias("posting_id"), "score", "rank")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = matching.best_matches(d.vector_profiles(spark, sf_dir), d.vector_postings(spark, sf_dir), 20, order=("id",))
    return matching.explain(ranked).withColumnsRenamed({"p_profile_id": "profile_id", "id": "posting_id"})


@query(f"WITH {d.RANK_SQL} SELECT profile_id, posting_id, CAST(rank AS INT) AS rank, round(score, 6) AS score, round(e, 6) AS embedding_score, round(s, 6) AS skill_score, round(xs, 6) AS experience_score FROM r WHERE rank <= 20")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = [F.round(c, 6).alias(c) for c in ("score", "embedding_score", "skill_score", "experience_score")]
    return _ranked(spark, sf_dir).select("profile_id", "posting_id", "rank", *six)


@query(f"WITH {d.RANK_SQL} SELECT profile_id, posting_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def bounded_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``hybrid_rank``, without looking at blocks of postings that can't be among the best."""
    ranked, _ = bounds.bounded_matches(d.vector_profiles(spark, sf_dir), d.vector_postings(spark, sf_dir), 20, order=("id",))
    return ranked.select(F.col("p_profile_id").alias("profile_id"), F.col("id").alias("posting_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {d.RANK_SQL} SELECT posting_id FROM j WHERE posting_id NOT IN (SELECT posting_id FROM r WHERE rank <= 20)")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unmatched(d.vector_postings(spark, sf_dir).select("id"), _ranked(spark, sf_dir)).withColumnRenamed("id", "posting_id")


@query(f"WITH {d.RANK_SQL} SELECT 'posting ' || posting_id AS title, round(score, 4) AS score, round(e, 4) AS embedding_score, array_to_string(list_filter(list_sort(list_distinct([req, pref])), lambda x: list_contains(ps, x)), ', ') AS matched_skills, array_to_string(list_filter(list_sort(list_distinct([req, pref])), lambda x: NOT list_contains(ps, x)), ', ') AS missing_skills FROM r WHERE rank <= 20")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_ranked(spark, sf_dir)).select("title", "score", "embedding_score", "matched_skills", "missing_skills")


@query("""WITH s AS (SELECT o_custkey AS profile_id, date_trunc('month', o_orderdate) AS a, date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 24 AS INT)) AS b FROM orders),
m AS (SELECT DISTINCT profile_id, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM s)
SELECT profile_id, count(*) AS months, round_even(count(*) / 12, 1) AS years FROM m GROUP BY profile_id""")
def experience_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.trunc("o_orderdate", "month")
    spans = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), start.alias("start"),
        F.add_months(start, (F.col("o_orderkey") % 24).cast("int")).alias("end")
    )
    rows = profiles.months_covered(spans, "profile_id")
    return rows.select("profile_id", "months", F.bround(F.col("months") / 12, 1).alias("years"))


# ---- state and streams -------------------------------------------------------------------------------------
_STATE = """WITH e AS (SELECT user_id AS posting_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'opened' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'not_interested' WHEN 'signup' THEN 'not_applied' END AS action FROM events),
s AS (SELECT posting_id, arg_max(action, (ts, seq)) AS state, max((ts, seq)) AS last FROM e WHERE action <> 'opened' GROUP BY posting_id),
o AS (SELECT e.posting_id, max(CASE WHEN last IS NULL OR ((ts, seq) > last AND state = 'not_applied') THEN ts END) AS opened FROM e LEFT JOIN s USING (posting_id) WHERE action = 'opened' GROUP BY e.posting_id)
SELECT posting_id, CASE WHEN opened IS NOT NULL THEN 'pending' ELSE state END AS status, opened IS NOT NULL AS confirmation_needed, opened AS pending_since FROM (SELECT DISTINCT posting_id FROM e WHERE action IS NOT NULL) LEFT JOIN s USING (posting_id) LEFT JOIN o USING (posting_id)"""


@query(_STATE)
def app_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_events(d.app_events(table(spark, sf_dir, "events")))


def _streamed(spark: SparkSession, sf_dir: str, name: str, flow: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """The last row of each key of a flow over a table that lands in four parts, in order of time.

    After each part the stream is started again from its checkpoint and takes what is new as one micro-batch, so
    state goes from batch to batch and over restarts.  Micro-batches are written to the shared folder with their
    number, the checkpoint lies beside them; nothing passes through the driver, and a batch that is run again writes
    the same folder again.
    """
    rows, root = table(spark, sf_dir, name), shared_path(spark, "stream")
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = rows.select(moment.alias("m")).approxQuantile("m", [0.25, 0.5, 0.75], 0.01)
    part = F.lit(0)
    for cut in sorted(set(cuts)):
        part = part + F.when(moment > F.lit(cut), 1).otherwise(0)
    rows.where(part == 0).write.parquet(f"{root}/in")
    out = flow(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for number in range(len(set(cuts)) + 1):
        if number:
            rows.where(part == number).write.mode("append").parquet(f"{root}/in")
        run = out.writeStream.outputMode("update").option(
            "checkpointLocation", f"{root}/checkpoint"
        ).foreachBatch(keep).trigger(availableNow=True).start()
        run.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in out.columns if c != key]), "batch").alias("r")).select(key, "r.*")


@query(_STATE)
def app_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "events", lambda e: flows.application_states(d.app_events(e)), "posting_id")


_PROGRESS = "SELECT user_id AS source_id, max(event_id % 10) AS last_page, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS detail_pages, bool_or(event_type = 'error') AS stopped_early, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id"


@query(_PROGRESS)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.progress_states(d.progress_events(table(spark, sf_dir, "events")))


@query(_PROGRESS)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "events", lambda e: flows.progress_states(d.progress_events(e)), "source_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, user_id % 7 AS source_id, count(*) AS n FROM events GROUP BY 1, 2")
def capture_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("captured_at"), (F.col("user_id") % 7).alias("source_id"))
    return flows.capture_counts(rows).select(F.col("hour.start").alias("hour"), "source_id", "n")




@query("""SELECT o_custkey % 7 AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, true AS active, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS first_batch, CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE 3 END AS last_batch,
CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS updated_batch FROM orders""")
def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures that arrive in four batches, each without a quarter of the keys, merged into a published snapshot.

    Captures land with the columns that they are made of, and their hash is kept as its 32 bytes, not as 64 digits: it
    is most of what a row weighs, and every row moves with each batch.
    """
    orders, root = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), shared_path(spark, "captures")
    none = F.lit(None).cast("timestamp")
    prepare = lambda b: b.select(
        (F.col("o_custkey") % 7).alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"),
        F.unhex(F.sha2(F.col("o_totalprice").cast("string"), 256)).alias("content_hash")
    )
    empty = prepare(orders).where("false").withColumns(
        {
            "active": F.lit(True), "first_seen_at": none, "last_seen_at": none, "last_updated_at": none,
            "application_status": F.lit("x"), "application_confirmation_needed": F.lit(False)
        }
    )
    merge = flows.merge_batches(prepare, f"{root}/snapshots", empty, lambda i: AS_OF + dt.timedelta(hours=i))
    for number in range(4):
        orders.where(F.col("o_orderkey") % 4 != number).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(orders.schema).parquet(f"{root}/in")
        stream.writeStream.foreachBatch(merge).option(
            "checkpointLocation", f"{root}/checkpoint"
        ).trigger(availableNow=True).start().awaitTermination()
    hours = lambda c: F.floor((F.unix_timestamp(c) - F.unix_timestamp(F.lit(AS_OF))) / 3600).cast("int")
    rows = read_current(spark, f"{root}/snapshots")
    return rows.select(
        "source_id", "external_id", "active",
        *[
            hours(F.col(f"{c}_at")).alias(n) for c,
            n in (("first_seen", "first_batch"), ("last_seen", "last_batch"), ("last_updated", "updated_batch"))
        ]
    )


@query(f"""WITH {d.SNAPSHOTS_SQL} SELECT coalesce(old.source_id, new.source_id) AS source_id, coalesce(old.external_id, new.external_id) AS external_id, new.h IS NOT NULL AS active,
CASE WHEN old.h IS NULL THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END AS first_seen_at, CASE WHEN new.h IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-31' END AS last_seen_at,
CASE WHEN new.h IS NULL OR old.h = new.h THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-31' END AS last_updated_at, coalesce(new.h, old.h) AS content_hash
FROM old FULL JOIN new ON old.source_id = new.source_id AND old.external_id = new.external_id""")
def sync_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.lit(dt.datetime(2024, 1, 1))
    old = d.old_snapshot(spark, sf_dir).withColumns(
        {
            "first_seen_at": then, "last_seen_at": then, "last_updated_at": then, "application_status": F.lit("applied"),
            "application_confirmation_needed": F.lit(False)
        }
    )
    rows = sync.publish(old, d.new_snapshot(spark, sf_dir).drop("active"), AS_OF)
    return rows.select("source_id", "external_id", "active", "first_seen_at", "last_seen_at", "last_updated_at", "content_hash")


@query(f"""WITH {d.SNAPSHOTS_SQL}, n AS (SELECT source_id, external_id, 1 AS v FROM old UNION SELECT source_id, external_id, 2 FROM new WHERE source_id IN (1, 3) UNION SELECT source_id, external_id, 3 FROM new WHERE source_id IN (3, 5))
SELECT source_id, CASE source_id WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 3 ELSE 1 END AS version, count(DISTINCT external_id) AS n FROM n GROUP BY source_id""")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, of all sources, of two and of two: the version that holds each source, and its rows."""
    root, new = shared_path(spark, "snapshots"), d.new_snapshot(spark, sf_dir).drop("active")
    then = F.lit(None).cast("timestamp")
    old = d.old_snapshot(spark, sf_dir).drop("active")
    empty = old.where("false").withColumns(
        {
            "active": F.lit(True), "first_seen_at": then, "last_seen_at": then, "last_updated_at": then,
            "application_status": F.lit("x"), "application_confirmation_needed": F.lit(False)
        }
    )
    for version, batch in enumerate((old, new.where("source_id in (1, 3)"), new.where("source_id in (3, 5)")), 1):
        publish_sources(spark, root, version, batch, lambda stored, sent: sync.publish(stored, sent, AS_OF), empty)
    rows = read_current(spark, root).groupBy("source_id").agg(F.count("*").alias("n"))
    held = manifest(spark, root, 3).select(F.col("part").cast("long").alias("source_id"), "version", F.col("n").alias("listed"))
    return rows.hint("merge").join(held, "source_id").where("n = listed").select("source_id", F.col("version").cast("int").alias("version"), "n")


_LAYOUT = [
    ("page", "detail", "title", 0, "h1"), ("page", "card", "container", 0, "li"), ("page", "card", "text", 0, "a"),
    ("page", "card", "href", 0, "a@href")
]


def _with_layout(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    layout = spark.createDataFrame(_LAYOUT, "layout string, scope string, field string, ord int, selector string")
    return extract.extract_layout(table(spark, sf_dir, "pages").withColumn("layout", F.lit("page")), layout, scope)


@query(r"""WITH h AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS t FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS title FROM h""")
def page_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's title; references count with and without their semicolon, as browsers read them."""
    return _with_layout(spark, sf_dir, "detail").select("page_id", "title")


@query(r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 2) AS t FROM pages)
SELECT page_id, i - 1 AS pos, replace(h[i], '&amp;', '&') AS href, replace(t[i], '&amp;', '&') AS text FROM c, unnest(range(1, len(h) + 1)) AS g(i)""")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_layout(spark, sf_dir, "card").select("page_id", F.col("pos").cast("long").alias("pos"), "href", "text")


@query("""WITH a AS (SELECT p_partkey, p_name, p_brand, p_retailprice AS p, format('{:,.2f}', p_retailprice) AS x FROM part),
b AS (SELECT *, CASE WHEN p >= 1000 THEN format('{:,}', CAST(round_even(p, 0) AS BIGINT)) WHEN p = floor(p) THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE format('{:.2f}', p) END AS y FROM a)
SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, p_brand AS company, p AS salary_min, 'hybrid' AS remote_mode, 3.0::DOUBLE AS experience_years,
p_name || ' at ' || p_brand || chr(10) || 'Remote mode: hybrid' || chr(10) || 'Type: contract' || chr(10) || 'Salary: $' || y || '/hr' || chr(10) || 'Hybrid contract work, 3 years of care. Salary $' || x || ' per hour' AS summary_text FROM b""")
def normalized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as payload rows, normalised to postings."""
    text = F.concat(F.lit("Hybrid contract work, 3 years of care. Salary $"), F.format_number("p_retailprice", 2), F.lit(" per hour"))
    payloads = d.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), "p_partkey").select(
        F.lit(1).alias("source_id"), F.col("p_partkey").cast("string").alias("raw_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"), text.alias("description")
    )
    sources = spark.createDataFrame(
        [(1, "Parts", "https://parts.example/list", "custom_url")], "id long, name string, url string, source_type string"
    )
    rows = normalize.normalize_postings(payloads, sources, {"Zymurgy": ["zymurgy"]})
    return rows.select("external_id", "title", "company", "salary_min", "remote_mode", "experience_years", "summary_text")


# the other modules register their queries when they are imported
from talentweave.plans import boards, resumes, upkeep, whole  # noqa: E402

__all__ = ["QUERIES", "SQL", "boards", "resumes", "upkeep", "whole"]
