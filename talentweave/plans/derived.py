"""Postings, listings, scans, profiles and events derived by Spark from the given tables.

Every derivation here has the same rule in SQL beside the query that uses it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, per_task: int = 20_000) -> DataFrame:
    """``rows`` of a table dealt by ``key``, at most some ``per_task`` to a task, and to all cores at least.

    A table of keys is a small file that one task reads, whatever is then worked out from each key; the number of
    tasks must come from its rows, which the file itself tells.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / per_task))
    return rows.repartition(n, key)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as postings."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "P", "pending").otherwise("not_applied")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return rows.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("location"),
        F.col("o_orderpriority").alias("description"), F.col("o_orderpriority").alias("job_type"), status.alias("application_status"), (F.col("o_orderkey") % 2 == 0).alias("application_confirmation_needed"),
        F.when(
            F.col("o_orderkey") % 3 == 0, F.array(F.lit("Secret"), F.lit("Polygraph"))
        ).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("Secret"))).otherwise(F.array().cast("array<string>")).alias("clearance_terms"),
        F.lit(True).alias("active"), F.lit("unknown").alias("remote_mode"), F.col("o_orderdate").alias("last_seen_at"), F.col("o_totalprice").alias("price"),
    )


POSTINGS_SQL = """
SELECT o_orderkey AS id, o_custkey % 7 AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, c_name AS company, c_mktsegment AS location,
  o_orderpriority AS description, o_orderpriority AS job_type,
  CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'pending' ELSE 'not_applied' END AS application_status,
  o_orderkey % 2 = 0 AS application_confirmation_needed, o_orderkey % 3 AS cleared, o_orderdate AS last_seen_at
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def _snapshot(spark: SparkSession, sf_dir: str, price: F.Column) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 7).alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"),
        F.sha2(price.cast("decimal(18,2)").cast("string"), 256).alias("content_hash"), F.col("o_orderkey").alias("key"),
        F.lit(True).alias("active")
    )


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, F.col("o_totalprice")).where("key % 10 <> 0").drop("key")


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return _snapshot(spark, sf_dir, price).where("key % 7 <> 0").drop("key")


SNAPSHOTS_SQL = """
old AS (SELECT o_custkey % 7 AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id,
  sha256(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 10 <> 0),
new AS (SELECT o_custkey % 7 AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id,
  sha256(CAST(CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 7 <> 0)
"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listing rows of suppliers' pages."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    known = F.col("l_orderkey") % 10 < 8 + F.col("l_suppkey") % 3
    return rows.select(
        F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("page"), F.row_number().over(w).alias("pos"),
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("external_id"), known.alias("known"), (~known).alias("needs_detail")
    )


LISTINGS_SQL = """
SELECT l_suppkey AS source_id, l_linenumber AS page,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) AS pos,
  concat_ws('-', l_orderkey, l_partkey) AS external_id, l_orderkey % 10 < 8 + l_suppkey % 3 AS known
FROM lineitem
"""


def vector_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a profile, with two skills and years."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    skills = F.array(F.concat(F.lit("s"), (F.col("vec_id") / 50 % 7).cast("int")), F.concat(F.lit("s"), F.col("label")))
    return e.select(
        F.col("vec_id").alias("profile_id"), F.col("embedding").cast("array<double>").alias("embedding"), skills.alias("skills"),
        (F.col("vec_id") % 4).cast("double").alias("experience_years"), F.array().cast("array<string>").alias("clearance_terms")
    )


def vector_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other vectors as postings with required and preferred skills and years."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 <> 0")
    s = lambda c: F.array(F.concat(F.lit("s"), c.cast("int")))
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), s(F.col("label")).alias("required_skills"), s(F.col("vec_id") % 7).alias("preferred_skills"), F.array().cast("array<string>").alias("skills"),
        F.array().cast("array<string>").alias("clearance_terms"), F.lit(None).cast("string").alias("salary_text"), (F.col("vec_id") % 6).cast("double").alias("experience_years"), F.lit(0).alias("last_seen_at"),
        F.concat(F.lit("posting "), F.col("vec_id")).alias("title"), F.col("label"),
    )


RANK_SQL = """
p AS (SELECT vec_id AS profile_id, CAST(embedding AS DOUBLE[]) AS pe, list_distinct(['s' || CAST(vec_id // 50 % 7 AS INT), 's' || label]) AS ps, CAST(vec_id % 4 AS DOUBLE) AS py FROM embeddings WHERE vec_id % 50 = 0),
j AS (SELECT vec_id AS posting_id, CAST(embedding AS DOUBLE[]) AS je, 's' || label AS req, 's' || CAST(vec_id % 7 AS INT) AS pref, CAST(vec_id % 6 AS DOUBLE) AS jy FROM embeddings WHERE vec_id % 50 <> 0),
x AS (SELECT profile_id, posting_id, greatest(0.0, least(1.0, list_cosine_similarity(pe, je))) AS e,
  CAST(list_contains(ps, req) AS INT) AS rm, CASE WHEN pref = req THEN 0.0 ELSE 0.55 END AS pw, CAST(list_contains(ps, pref) AS INT) AS pm, req, pref, ps,
  CASE WHEN jy = 0 THEN 1.0 WHEN py <= 0 THEN 0.0 ELSE least(py / jy, 1.0) END AS xs FROM p, j),
y AS (SELECT *, 0.75 * (rm + pw * pm) / (1 + pw) + 0.25 * rm AS s FROM x),
z AS (SELECT *, 0.68 * e + 0.22 * s + 0.10 * xs AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posting_id DESC) AS rank FROM z)
"""


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, name): words of the names of the parts that a supplier ships."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select(
        F.col("l_suppkey").alias("suppkey"), F.explode(F.split("p_name", " ")).alias("name")
    ).distinct()


def app_events(events: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "opened").when(F.col("event_type") == "purchase", "applied").when(
        F.col("event_type") == "error", "not_interested"
    ).when(F.col("event_type") == "signup", "not_applied").otherwise("ignored")
    return events.select(F.col("user_id").alias("posting_id"), "ts", F.col("event_id").alias("seq"), action.alias("action"))


def progress_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("page"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("detail_pages"),
        (F.col("event_type") == "error").alias("stopped_early"), F.col("event_type").alias("status")
    )
