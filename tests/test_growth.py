"""What joins bring together and what tasks hold grows with the tables, not with their squares."""

import datetime as dt
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(__file__))
from oracle import rows as plain_rows

from pyspark.sql import functions as F

from talentweave.functions.dates import partial_date
from talentweave.operators import annotate, matching, normalize, profiles, terms
from talentweave.plans import boards, derived, resumes
from talentweave.plans.queries import QUERIES, SQL
from talentweave.sources import snapshots


def test_common_tokens_bring_no_names_together(spark):
    ids = spark.range(300)
    left = ids.select(F.concat(F.lit("machine learning nr"), "id").alias("name"))
    right = ids.select(F.concat(F.lit("Machine Learning models nr"), "id").alias("name"))
    lexicon = spark.createDataFrame([("Go", "golang", "x", 1)], "canonical string, alias string, category string, ord int")
    a, b = terms._described(left, lexicon, "left"), terms._described(right, lexicon, "right")
    assert terms._paired(a, b).count() < 3000  # of 90,000 pairs
    assert terms.skill_pairs(left, right, lexicon).count() == 300


def test_titles_of_references_without_semicolon(spark, tmp_path):
    titles = ["a &amp; b&amp", "&lt;x&gt &quot;y&quot", "cut &am", " &amp;lt; ", "none"]
    html = [f"<html><h1>{t}</h1></html>" for t in titles]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(SQL["page_detail"]).df()
    assert dict(zip(want.page_id, want.title)) == {0: "a & b&", 1: '<x> "y"', 2: "cut &am", 3: "&lt;", 4: "none"}
    assert plain_rows(QUERIES["page_detail"](spark, str(tmp_path)).toPandas()) == plain_rows(want)


def test_few_rows_of_keys_use_all_cores(spark, tmp_path):
    keys = spark.range(100).select(F.col("id").alias("c_custkey"))
    keys.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    texts = resumes._texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert derived.spread(keys, "c_custkey", per_task=10).rdd.getNumPartitions() == 10  # as many as the rows ask for


def test_texts_land_as_one_file_each_in_one_folder(spark):
    texts = [(i, f"line {i}\nand more") for i in range(5)]
    path = boards._landed(spark.createDataFrame(texts, "file long, text string"), "texts")
    got = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").collect()
    assert sorted(r.value for r in got) == [t + "\n" for _, t in texts]
    assert len({r.file_path for r in got}) == 5 and len({os.path.dirname(r.file_path) for r in got}) == 1


def test_ranges_and_partial_dates(spark):
    given = ["jan 2021", "Sept. 2020", "September 2019", "Sep 2019", "may 2010", "03/2020", "13/2020", "0/2020", "2018", "0000", "Jan  2021", "janu 2021", "now", None]
    want = ["2021-01-01", None, "2019-09-01", "2019-09-01", "2010-05-01", "2020-03-01", None, None, "2018-01-01", None, None, None, "2024-01-01", None]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, t string").withColumn("d", partial_date(F.col("t"), dt.date(2024, 1, 31)).cast("string"))
    assert [r.d for r in rows.orderBy("id").collect()] == want
    plan = rows._jdf.queryExecution().toString()
    assert "gettimestamp" not in plan.lower()  # a format that does not fit costs an exception
    text = "Lead Jan 2001 - Dec 2003, Clerk 4/2010 to now\nCook 2015–2012"
    got = profiles.spans(spark.createDataFrame([(1, text)], "resume_id int, text string"), dt.date(2024, 1, 31)).orderBy("pos").collect()
    assert [(r.label, str(r.start), str(r.end)) for r in got] == [("Jan 2001 - Dec 2003", "2001-01-01", "2003-12-01"), ("4/2010 to now", "2010-04-01", "2024-01-01")]


def test_parts_without_digits_are_not_searched_for_pay(spark, col):
    assert "Contract" not in col(annotate._segments(F.lit("Contract | $20 - $30 per hour | Overtime")))
    for text, shown in (("from 20k – 30k a year, salary", "$20,000 - $30,000/yr"), ("Pay: up to $50 per hour", "$50/hr"), ("no pay told", None), ("salary is 1,000 and 2,000 per month", "$1,000 - $2,000/mo")):
        assert col(annotate.salary(F.lit(text)))["display"] == shown


def test_all_postings_of_one_source_do_not_meet_in_one_task(spark):
    rows = spark.range(50).select(F.lit(1).alias("source_id"), F.concat(F.lit("t"), "id").alias("title"))
    sources = spark.createDataFrame([(1, "S", "https://s.example/", "custom_url")], "id long, name string, url string, source_type string")
    got = normalize.normalize_postings(rows, sources, {})
    assert "Broadcast" in got._jdf.queryExecution().executedPlan().toString() and got.where("source_name = 'S'").count() == 50


def test_runs_that_are_no_alias_are_dropped_before_the_join(spark):
    names = spark.createDataFrame([("order no. 7",), ("order",), (".net",), ("a b c d",)], "alias string")
    held = names.select("alias", F.regexp_extract_all("alias", F.lit(f"({terms._PIECES.pattern})"), 1).alias("t"))
    begun = lambda a, b: F.expr(f"transform(filter(sequence(1, size(t)), n -> n between {a} and {b}), n -> array_join(slice(t, 1, n), ''))")
    starts, inner, whole = terms._bits(held, begun(1, 2), terms.STARTS), terms._bits(held, begun(3, 4), terms.INNER), terms._bits(held, F.array("alias"), terms.INNER)
    find = lambda t: terms._runs_of(t, 4, bytes(starts), bytes(inner), bytes(whole))
    assert find(" ".join(f"w{i}" for i in range(300))) == set()
    assert find("my order no. 7, not order no. 77 of asp.net or .net; a b c d") == {"order no. 7", "order", ".net", "a b c d"}


def test_captures_land_and_move_with_what_they_need(spark, tmp_path):
    """A capture's landed columns and its hash of 32 bytes are all that moves; SQL gives the same rows."""
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"), (F.col("id") % 11).alias("o_custkey"), (F.col("id") * 1.5).alias("o_totalprice"), F.lit("x" * 50).alias("o_comment"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["capture_stream"](spark, str(tmp_path))
    root = got.inputFiles()[0].split("/snapshots/")[0]
    assert spark.read.parquet(f"{root}/in").columns == ["o_orderkey", "o_custkey", "o_totalprice"]
    assert {r.n for r in spark.read.parquet(f"{root}/snapshots/rows").select(F.length("content_hash").alias("n")).collect()} == {32}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert plain_rows(got.toPandas()) == plain_rows(con.sql(SQL["capture_stream"]).df())


def test_rows_of_few_sources_are_written_where_they_were_merged(spark):
    rows = spark.range(9).select(F.col("id").cast("string").alias("part"))
    plan = lambda n: snapshots._dealt(rows, spark.range(n))._jdf.queryExecution().toString()
    assert "Rebalance" not in plan(snapshots.FEW_PARTS) and "Rebalance" in plan(snapshots.FEW_PARTS + 1)


def test_only_a_profiles_best_of_all_blocks_become_rows(spark, monkeypatch):
    people = spark.range(3).select(
        F.col("id").alias("profile_id"), F.array(F.lit(1.0), F.col("id") / 9).alias("embedding"), F.array(F.lit("a")).alias("skills"), F.lit(1.0).alias("experience_years")
    )
    none = F.array().cast("array<string>")
    posts = spark.range(400).select(
        "id", F.array(F.cos("id"), F.sin("id")).alias("embedding"), F.array(F.lit("a")).alias("required_skills"), none.alias("preferred_skills"), none.alias("skills"),
        F.lit(1.0).alias("experience_years"), F.lit(0).alias("last_seen_at")
    )
    scored, given = matching._scored, []
    monkeypatch.setattr(matching, "_scored", lambda rows, *more: given.append(rows) or scored(rows, *more))
    got = {(r.p_profile_id, r.id, r.rank) for r in matching.best_matches(people, posts, 5).collect()}
    assert given[0].count() == 15  # five a profile, not five of each block
    assert got == {(r.p_profile_id, r.id, r.rank) for r in matching.top_k(matching.score_pairs(people, posts), 5).collect()}
    found = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.7, 0.7, 0.5, 0.695, 0.8])] + [(2, 9, 0.1)], "p_profile_id long, id long, score double")
    assert {tuple(r) for r in matching.nearest_of_all(found, 3, 0.01).collect()} == {(1, 0), (1, 1), (1, 2), (1, 4), (1, 5), (2, 9)}  # ties and what is near them stay
