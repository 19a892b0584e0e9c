"""Queries over résumés: texts put together from the customers' keys, so that SQL knows what must be read from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.functions.dates import parse_time, partial_date
from talentweave.operators import normalize, profiles
from talentweave.operators.annotate import clearance
from talentweave.plans.derived import spread, table
from talentweave.plans.registry import AS_OF, chosen, query

DAY = AS_OF.date()
TITLES = ["Data Engineer", "Support Analyst", "Platform Architect", "Project Manager", "Welding Technician"]
COMPANIES = ["Acme", "Borealis", "Cobalt", "Dune"]
CITIES = ["Oslo, NO", "Denver, CO", "Lyon, FR"]
NAMES = ["Alex Stone", "Sam River", "Kim Field"]
SCHOOLS = ["North", "South", "West"]
SKILLS = ["Python, Azure", "Azure", "Welding and Python", "reading"]
#: Entry i of résumé k, and its first year; the last of 1 to 3 entries goes on.
_ENTRY = {
    "title": chosen("(k + i)", TITLES), "company": chosen("(k + 3 * i)", COMPANIES), "place": chosen("(k + i)", CITIES),
    "y": "(2001 + 3 * i + k % 4)"
}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resume_id, text) of all customers."""
    e = _ENTRY
    until = f"CASE WHEN i = k % 3 THEN 'present' ELSE concat('Dec ', {e['y']} + 1) END"
    entry = f"concat_ws('\n', concat({e['title']}, ' Jan ', {e['y']}, ' - ', {until}), concat({e['title']}, ' at ', {e['company']}), {e['place']}, concat('- Did thing ', i, ' for ', k), '* And more')"
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id")), "resume_id").withColumn("k", F.col("resume_id"))
    return rows.select("resume_id", F.expr(f"""concat_ws('\n', {chosen('k', NAMES)}, concat('alex', k, '@mail.example | 555-123-', lpad(cast(k % 10000 as string), 4, '0')), {chosen('k', CITIES)},
        concat('https://www.linkedin.com/in/alex', k), concat('https://alex', k, '.example/home'), 'SUMMARY', CASE WHEN k % 2 = 0 THEN 'Holds an active Secret clearance.' ELSE 'Works with care.' END, 'Experience:',
        array_join(transform(sequence(0, cast(k % 3 as int)), i -> {entry}), '\n'), 'Page 2 of 3', 'EDUCATION', 'Bachelor of Science 1995 - 1999', concat({chosen('k', SCHOOLS)}, ' University'), concat('Honors ', k % 7), 'Skills', {chosen('k', SKILLS)})""").alias("text"))


def _lines(spark: SparkSession, sf_dir: str, section: str) -> DataFrame:
    rows = profiles.sectioned(profiles.lines(_texts(spark, sf_dir)))
    return rows.where(F.col("section") == section).drop("section")


def _dates() -> list[F.Column]:
    return [F.col(c).cast("string").alias(c) for c in ("start_date", "end_date")]


_ENTRIES = f"""e AS (SELECT k, i, {_ENTRY['title']} AS title, {_ENTRY['company']} AS company, {_ENTRY['place']} AS place, {_ENTRY['y']} AS y, i = k % 3 AS current
FROM (SELECT c_custkey AS k, unnest(range(0, c_custkey % 3 + 1)) AS i FROM customer))"""


@query(f"WITH {_ENTRIES} SELECT k AS resume_id, i + 1 AS n, title, company, place AS location, y || '-01-01' AS start_date, CASE WHEN current THEN '2024-01-01' ELSE (y + 1) || '-12-01' END AS end_date, current AS is_current, 'Did thing ' || i || ' for ' || k || ' And more' AS description FROM e")
def resume_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.work_history(_lines(spark, sf_dir, "experience"), DAY)
    return rows.select("resume_id", F.col("n").cast("long").alias("n"), "title", "company", "location", *_dates(), "is_current", "description")


@query(f"SELECT c_custkey AS resume_id, 1 AS n, {chosen('c_custkey', SCHOOLS)} || ' University' AS school, 'Bachelor of Science' AS degree, '1995-01-01' AS start_date, '1999-01-01' AS end_date, 'Honors ' || c_custkey % 7 AS description FROM customer")
def resume_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.education(_lines(spark, sf_dir, "education"), DAY).withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(f"WITH {_ENTRIES} SELECT k AS resume_id, string_agg(title, ', ' ORDER BY i) AS titles FROM e GROUP BY k")
def resume_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.recent_titles(_lines(spark, sf_dir, "experience")).select("resume_id", F.array_join("titles", ", ").alias("titles"))


_MONTHS = "m AS (SELECT c_custkey AS k, 49 + 24 * (c_custkey % 3) + 12 * (2024 - (2001 + 3 * (c_custkey % 3) + c_custkey % 4)) + 1 AS months FROM customer)"


@query(f"WITH {_MONTHS} SELECT k AS resume_id, round_even(months / 12, 1) AS experience_years FROM m")
def resume_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.experience_years(_texts(spark, sf_dir), DAY)


@query(f"""SELECT c_custkey AS resume_id, {chosen('c_custkey', NAMES)} AS full_name, 'alex' || c_custkey || '@mail.example' AS email, '555-123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
'https://www.linkedin.com/in/alex' || c_custkey AS linkedin_url, 'https://alex' || c_custkey || '.example/home' AS website_url, {chosen('c_custkey', CITIES)} AS location FROM customer""")
def resume_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.contacts(profiles.lines(_texts(spark, sf_dir)))


_LEXICON = {"Python": ["python"], "Azure": ["azure"], "Welding": ["welding"]}


@query(f"""WITH {_MONTHS}, {_ENTRIES}, t AS (SELECT k, string_agg(title, ', ' ORDER BY i) AS titles, bool_or(title = 'Welding Technician') AS welds FROM e GROUP BY k)
SELECT m.k AS resume_id, round_even(months / 12, 1) AS experience_years, CASE WHEN m.k % 2 = 0 THEN 'Secret' ELSE '' END AS clearance_terms, titles,
CASE m.k % 4 WHEN 0 THEN 'Azure, Python' WHEN 1 THEN 'Azure' WHEN 2 THEN 'Python' ELSE '' END || CASE WHEN m.k % 4 = 2 THEN ', Welding' WHEN NOT welds THEN '' WHEN m.k % 4 = 3 THEN 'Welding' ELSE ', Welding' END AS skills,
CASE WHEN m.k % 4 < 2 THEN 'Azure' ELSE '' END AS tools FROM m JOIN t ON m.k = t.k""")
def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.structure(
        _texts(spark, sf_dir), _LEXICON, {"Python": "language", "Azure": "cloud", "Welding": "craft"}, {"CISSP": ["cissp"]}, DAY
    )
    return rows.select("resume_id", "experience_years", *[F.array_join(c, ", ").alias(c) for c in ("clearance_terms", "titles", "skills", "tools")])


@query("SELECT s_suppkey AS resume_id, 1::BIGINT AS n, 'Data Engineer' AS title, '' AS company, (2001 + s_suppkey % 9) || '-01-01' AS start_date, (2003 + s_suppkey % 9) || '-01-01' AS end_date, false AS is_current FROM supplier")
def resume_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience without an entry that names a title or company: spans and titles are paired."""
    texts = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("resume_id"),
        F.expr("concat(2001 + s_suppkey % 9, ' - ', 2003 + s_suppkey % 9, '\n- Made things\nData Engineer')").alias("text")
    )
    rows = profiles.history_of(profiles.lines(texts), profiles.spans(texts, DAY), DAY)
    return rows.select("resume_id", F.col("n").cast("long").alias("n"), "title", "company", *_dates(), "is_current")


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Lead ' || c_custkey ELSE '' END AS head FROM customer)
SELECT k AS resume_id, k % 3 > 0 AS has_vector, CASE WHEN k % 3 = 0 THEN concat_ws(chr(10), CASE WHEN head <> '' THEN 'Headline: ' || head END, 'Recent titles: ' || CASE WHEN head <> '' THEN head || ', ' ELSE '' END || 'Engineer',
  'Skills: Azure, Go', 'Clearance: Secret', CASE WHEN k % 5 > 0 THEN 'Estimated experience: ' || k % 5 || '.0 years' END, 'Profile: Likes work', 'Experience highlights: Engineer | Acme | Built it', 'Projects: side work') ELSE 'as it was' END AS summary_text,
CASE WHEN k % 3 = 0 THEN 'Azure, Go' ELSE 'Old' END AS skills, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_jobs FROM p""")
def profile_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third profile is edited as a whole; the others stay."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"))
    stored = rows.withColumns(
        {
            "skills": F.array(F.lit("Old")), "tools": F.array().cast("array<string>"),
            "certifications": F.array().cast("array<string>"), "clearance_terms": F.array().cast("array<string>"),
            "titles": F.array().cast("array<string>"), "experience_years": F.lit(1.0),
            "sections": F.create_map(F.lit("projects"), F.lit("side work")), "summary_text": F.lit("as it was"),
            "content_hash": F.lit("h"), "embedding": F.array(F.lit(1.0)), "profile": F.lit(None).cast(profiles.PROFILE)
        }
    )
    job = "named_struct('title', title, 'company', company, 'location', '', 'start_date', '2020-01-01', 'end_date', '', 'is_current', true, 'description', told)"
    made = F.expr(f"""named_struct('basics', named_struct('full_name', 'Jo  Doe', 'email', '', 'phone', '', 'location', '', 'linkedin_url', '', 'website_url', '', 'headline', CASE WHEN resume_id % 2 = 0 THEN concat('Lead  ', resume_id) END, 'summary', ' Likes work ', 'years_experience', cast(resume_id % 5 as double)),
      'work_history', transform(array(named_struct('title', ' Engineer', 'company', 'Acme', 'told', '<p>Built it</p>'), named_struct('title', '', 'company', ' ', 'told', '')), x -> {job.replace('title,', 'x.title,').replace('company,', 'x.company,').replace('told)', 'x.told)')}),
      'education', cast(array() as array<struct<school:string,degree:string,field_of_study:string,start_date:string,end_date:string,description:string>>), 'skills', array('Azure', ' azure', '', 'Go'), 'tools', cast(array() as array<string>), 'certifications', cast(null as array<string>),
      'clearance_terms', array('Secret'), 'recent_titles', cast(array() as array<string>), 'experience_years', 0.0D)""")
    got = profiles.edit_profiles(stored, rows.where("resume_id % 3 = 0").select("resume_id", made.alias("profile")))
    return got.select(
        "resume_id", F.col("embedding").isNotNull().alias("has_vector"), "summary_text",
        F.array_join("skills", ", ").alias("skills"), F.coalesce(F.size("profile.work_history"), F.lit(0)).alias("n_jobs")
    )


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("owner"), F.col("o_orderpriority").alias("file_hash"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at")
    )


_SAVED = """o AS (SELECT o_orderkey AS id, o_custkey % 50 AS owner, o_orderpriority AS file_hash, o_orderdate AS made FROM orders),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, file_hash ORDER BY made DESC, id DESC) AS n FROM o) WHERE n = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY made DESC, id DESC) = 1 AS is_active FROM k)"""


@query(f"WITH {_SAVED} SELECT id, owner, is_active FROM a")
def active_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.single_active(_saved(spark, sf_dir)).select("id", "owner", "is_active")


# ---- enrichment ----------------------------------------------------------------------------------------------
@query("""SELECT c_custkey AS resume_id, CASE WHEN c_custkey % 3 = 0 THEN 'Azure, Go, Python' ELSE 'Python' END AS skills, CASE WHEN c_custkey % 3 = 0 THEN 'Clerk, Lead, clerk 2' ELSE 'Clerk' END AS titles,
CASE WHEN c_custkey % 3 = 0 THEN greatest(3.0, c_custkey % 7) ELSE 3.0 END::DOUBLE AS experience_years FROM customer""")
def enriched_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"))
    held = rows.withColumns(
        {"skills": a("Python"), "tools": a(), "certifications": a(), "clearance_terms": a(), "titles": a("Clerk"), "experience_years": F.lit(3.0)}
    )
    told = rows.where("resume_id % 3 = 0").withColumns(
        {
            "skills": a("Go", "Azure", "python"), "tools": a(), "certifications": a(), "clearance_terms": a(),
            "recent_titles": a("clerk", "Lead", "clerk 2"), "experience_years_hint": (F.col("resume_id") % 7).cast("double")
        }
    )
    got = normalize.enrich_profiles(held, told)
    return got.select("resume_id", F.array_join("skills", ", ").alias("skills"), F.array_join("titles", ", ").alias("titles"), "experience_years")


@query("""WITH r AS (SELECT p_partkey AS k, p_partkey % 4 AS kind FROM part)
SELECT CAST(k AS VARCHAR) AS external_id, CASE WHEN kind < 2 THEN 'Azure, Go' ELSE 'Go' END AS required_skills, CASE WHEN kind < 2 THEN 'Python' ELSE 'Azure, Python' END AS preferred_skills,
CASE WHEN kind < 2 THEN '$20 - $30/hr' END AS salary_text, CASE WHEN kind < 2 THEN 'contract' END AS job_type, CASE WHEN kind < 2 THEN 'remote' ELSE 'unknown' END AS remote_mode, CASE WHEN kind < 2 THEN 5.0 ELSE 2.0 END::DOUBLE AS experience_years FROM r""")
def enriched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model, as JSON or with words around it, merged into postings; others change nothing."""
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        F.lit(1).alias("source_id"), F.col("p_partkey").cast("string").alias("external_id"),
        (F.col("p_partkey") % 4).alias("kind")
    )
    held = rows.drop("kind").withColumns(
        {
            "required_skills": a("Go"), "preferred_skills": a("Azure", "Python"), "skills": a("Go"), "clearance_terms": a(),
            "clearance_summary": F.lit(""), "salary_min": F.lit(None).cast("double"), "salary_max": F.lit(None).cast("double"),
            "salary_interval": none, "salary_text": none, "job_type": none, "remote_mode": F.lit("unknown"),
            "experience_years": F.lit(2.0), "told_summary": F.lit("")
        }
    )
    reply = '{"required_skills": ["Azure"], "salary_text": "$20 - $30 per hour", "job_type": " contract ", "remote_mode": "remote", "experience_years_hint": 5, "short_summary": "fine"}'
    text = F.when(F.col("kind") == 0, reply).when(
        F.col("kind") == 1, f"Sure, here it is:\n{reply} Good luck!"
    ).when(F.col("kind") == 2, "no answer").otherwise("{broken")
    got = normalize.enrich_postings(held, normalize.parse_replies(rows.select("source_id", "external_id", text.alias("reply"))))
    return got.select(
        "external_id", F.array_join("required_skills", ", ").alias("required_skills"),
        F.array_join("preferred_skills", ", ").alias("preferred_skills"), "salary_text", "job_type", "remote_mode",
        "experience_years"
    )


@query("SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM (SELECT o_orderkey AS id, o_custkey % 7 AS source_id FROM orders WHERE o_orderkey % 3 <> 0)) WHERE n <= 20")
def to_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("short")).otherwise(F.repeat(F.lit("long "), F.lit(30)))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("source_id"), text.alias("description")
    )
    return normalize.to_enrich(rows).select("id", "source_id")


# ---- clearance -----------------------------------------------------------------------------------------------
_TOLD = [
    ("Active TS/SCI clearance needed. Nice office.", "TS/SCI", "TS/SCI (active/current)"),
    ("You must be able to obtain a Secret clearance!", "Secret", "Secret (eligible to obtain)"),
    ("Top Secret clearance with CI polygraph; lunch is free.", "Top Secret, CI Polygraph", "Top Secret CI Polygraph"),
    ("A secret recipe. Keep it.", "", ""),
    ("Public Trust position. Full scope polygraph held.", "Public Trust, Full Scope Polygraph", "Public Trust Full Scope Polygraph (active/current)"),
]


@query(f"SELECT o_orderkey AS id, {chosen('o_orderkey', [x[1] for x in _TOLD])} AS terms, {chosen('o_orderkey', [x[2] for x in _TOLD])} AS summary FROM orders")
def clearance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr(f"concat({chosen('o_orderkey', [x[0] for x in _TOLD])}, ' Ref ', o_orderkey, '.')").alias("text")
    )
    return rows.select("id", clearance(F.col("text")).alias("c")).select("id", F.array_join("c.terms", ", ").alias("terms"), "c.summary")


# ---- dates ---------------------------------------------------------------------------------------------------
_PARTIAL = [
    ("Jan 2021", "2021-01-01"), ("September 2019", "2019-09-01"), ("3/2020", "2020-03-01"), ("2018", "2018-01-01"),
    ("Present", "2024-01-01"), ("sometime", None)
]
_TIMES = [
    ("2024-03-05T10:00:00Z", "2024-03-05 10:00:00"), ("1709632800000", "2024-03-05 10:00:00"),
    ("1709632800", "2024-03-05 10:00:00"), ("March 5, 2024", "2024-03-05 00:00:00"), ("0", None), ("", None), ("soon", None)
]


@query(f"SELECT o_orderkey AS id, {chosen('o_orderkey', [x[1] for x in _PARTIAL])} AS month, CAST({chosen('o_orderkey', [x[1] for x in _TIMES])} AS TIMESTAMP) AS posted FROM orders")
def dates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr(chosen("o_orderkey", [x[0] for x in _PARTIAL])).alias("a"),
        F.expr(chosen("o_orderkey", [x[0] for x in _TIMES])).alias("b")
    )
    return rows.select("id", partial_date(F.col("a"), dt.date(2024, 1, 31)).cast("string").alias("month"), parse_time(F.col("b")).alias("posted"))
