from pyspark.sql import functions as F

from talentweave.operators.keyfilter import key_filter, may_match
from talentweave.operators.listings import with_known

KEYS = ["source_id", "external_id"]


def _rows(spark, begin, end, step=1):
    return spark.range(begin, end, step).select((F.col("id") % 5).alias("source_id"), F.col("id").cast("string").alias("external_id"))


def test_all_that_match_stay_and_few_others(spark):
    stored, asked = _rows(spark, 0, 60_000), _rows(spark, 0, 60_000, 100)
    kept = may_match(stored, key_filter(asked, KEYS), KEYS)
    assert kept.columns == KEYS and kept.join(asked, KEYS, "left_semi").count() == 600
    assert kept.count() < 700
    assert "Exchange hashpartitioning(source_id" not in kept._jdf.queryExecution().executedPlan().toString()


def test_nulls_repeats_and_none(spark):
    rows = spark.createDataFrame([(1, None), (None, "a"), (None, None), (2, "b"), (2, "b")], "source_id long, external_id string")
    assert may_match(rows, key_filter(rows, KEYS), KEYS).count() == 5
    assert may_match(rows, key_filter(rows.where("false"), KEYS), KEYS).count() == 0
    assert may_match(rows.where("false"), key_filter(rows, KEYS), KEYS).count() == 0


def test_listings_against_a_pruned_index(spark):
    texts = {"description": F.lit("told"), "employment_text": F.lit(""), "salary_text": F.lit("")}
    known = _rows(spark, 0, 20_000).withColumns(texts | {"listing_hash": F.col("external_id")})
    new = _rows(spark, 19_900, 20_100).withColumns(texts | {"listing_hash": F.when(F.col("external_id").endswith("7"), "x").otherwise(F.col("external_id")), "description": F.lit("")})
    rows = lambda prune: sorted(map(tuple, with_known(new, known, prune).collect()))
    assert rows(True) == rows(False) and sum(r.known_listing for r in with_known(new, known, True).collect()) == 90
