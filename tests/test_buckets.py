import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentweave.operators import sync
from talentweave.sources.buckets import bucketed_scratch, replace_bucketed, save_bucketed

NOW = dt.datetime(2024, 5, 1)


def _stored(spark, n=400):
    then = F.lit(NOW - dt.timedelta(days=1))
    return spark.range(n).select(
        (F.col("id") % 7).alias("source_id"), F.col("id").cast("string").alias("external_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit(True).alias("active"),
        *[then.alias(c) for c in ("first_seen_at", "last_seen_at", "last_updated_at")], F.lit("applied").alias("application_status"), F.lit(False).alias("application_confirmation_needed")
    )


def _batch(spark):
    value = F.when(F.col("id") % 3 == 0, F.col("id") + 1).otherwise(F.col("id"))
    return spark.range(100, 500).select((F.col("id") % 7).alias("source_id"), F.col("id").cast("string").alias("external_id"), F.sha2(value.cast("string"), 256).alias("content_hash"))


def _exchanged(df) -> list[str]:
    """The scans below each exchange by a key of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            inside = range(i + 1, next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)))
            out += [lines[j] for j in inside if "Scan" in lines[j] or "Range" in lines[j]]
    return out


def test_the_stored_side_is_not_exchanged(spark):
    stored, batch = bucketed_scratch(_stored(spark)), _batch(spark)
    for got in (sync.compare(stored, batch), sync.publish(stored, batch, NOW)):
        assert _exchanged(got) and not any("stored_" in x for x in _exchanged(got))
    assert any("Range" in x for x in _exchanged(sync.compare(_stored(spark), batch)))
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(sync.compare(stored, batch)) == same(sync.compare(_stored(spark), batch))


def test_more_buckets_than_shuffle_partitions_but_not_fewer(spark):
    got = sync.compare(save_bucketed(_stored(spark), "stored_by_16", buckets=16), _batch(spark))
    assert not any("stored_by_16" in x for x in _exchanged(got)) and got.count() == 500
    spark.sql("DROP TABLE stored_by_16")
    with pytest.raises(ValueError, match="fewer"):
        save_bucketed(_stored(spark), "stored_by_2", buckets=2)


def test_a_batch_in_place(spark):
    stored = save_bucketed(_stored(spark), "stored_twice")
    rows = sync.publish(stored, _batch(spark), NOW)
    want = sorted(map(tuple, rows.collect()))
    now = replace_bucketed(spark, "stored_twice", rows)
    assert sorted(map(tuple, now.collect())) == want
    assert not any("stored_twice" in x for x in _exchanged(sync.compare(now, _batch(spark))))
    assert sync.counts(sync.compare(now, _batch(spark))).agg(F.sum("unchanged")).first()[0] == 400
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("stored_twice")] == ["stored_twice"]
    spark.sql("DROP TABLE stored_twice")


def test_an_empty_stored_table(spark):
    stored = bucketed_scratch(_stored(spark).where("false"))
    assert {r.action for r in sync.compare(stored, _batch(spark)).collect()} == {"created"}
