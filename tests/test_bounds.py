import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from talentweave.operators import bounds, matching, profiles

PROFILE = "profile_id long, embedding array<double>, skills array<string>, experience_years double, clearance_terms array<string>"
POSTING = "id long, embedding array<double>, required_skills array<string>, preferred_skills array<string>, skills array<string>, clearance_terms array<string>, salary_text string, experience_years double, last_seen_at int"


def _tables(spark, n, people=12, copies=0):
    r = np.random.default_rng(5)
    topics = r.normal(size=(12, 16))
    skill = lambda t: [f"s{t}", f"s{int(r.integers(12))}"]
    posts = []
    for i in range(n):
        t = int(r.integers(12))
        vector = None if i % 97 == 0 else [0.0] * 16 if i % 101 == 0 else (topics[t] + 0.15 * r.normal(size=16)).tolist()
        posts.append((i, vector, skill(t)[:1] if i % 5 else [], skill(t)[1:], [], [], None, float(i % 7) if i % 3 else None, i % 4))
    posts += [(n + i, topics[0].tolist(), ["s0"], [], [], [], None, 2.0, 0) for i in range(copies)]
    who = [(i, (topics[i % 12] + 0.1 * r.normal(size=16)).tolist() if i % 11 else None, skill(i % 12) if i % 4 else [], float(i % 5), []) for i in range(people)]
    return spark.createDataFrame(who, PROFILE), spark.createDataFrame(posts, POSTING).repartition(4)


def _same(a, b):
    rows = lambda df: sorted((r.p_profile_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    return rows(a) == rows(b)


def test_bounded_ranking_is_the_whole_ranking_and_leaves_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(bounds, "PER_BLOCK", 40)
    people, posts = _tables(spark, 4000)
    ranked, visited = bounds.bounded_matches(people, posts, 10)
    assert _same(ranked, matching.best_matches(people, posts, 10))
    seen = visited.agg(F.sum("blocks"), F.sum("searched")).first()
    assert seen[1] < 0.5 * seen[0]


def test_bounded_ranking_of_copies_few_postings_and_pairs_of_names(spark, monkeypatch):
    monkeypatch.setattr(bounds, "PER_BLOCK", 50)
    people, posts = _tables(spark, 300, copies=700)  # most postings are alike
    assert _same(bounds.bounded_matches(people, posts, 10)[0], matching.best_matches(people, posts, 10))
    people, posts = _tables(spark, 6)  # fewer than k
    assert _same(bounds.bounded_matches(people, posts, 10)[0], matching.best_matches(people, posts, 10))
    names = spark.createDataFrame([("s1", "s2"), ("s1", "s1"), ("s3", "s0")], "left string, right string")
    people, posts = _tables(spark, 200)
    assert _same(bounds.bounded_matches(people, posts, 7, names)[0], matching.best_matches(people, posts, 7, names))
    assert bounds.bounded_matches(people, posts.where("false"), 7)[0].count() == 0


def test_months_of_spans_that_meet_overlap_or_repeat(spark):
    r, rows, want = random.Random(3), [], {}
    for key in range(40):
        months = set()
        for _ in range(r.randint(1, 12)):
            first = r.randint(0, 120)
            last = first + r.randint(-2, 30)
            rows.append((key, dt.date(2000 + first // 12, first % 12 + 1, r.randint(1, 28)), dt.date(2000 + last // 12, last % 12 + 1, r.randint(1, 28))))
            months |= set(range(first, last + 1))
        if months:
            want[key] = months
    spans = spark.createDataFrame([*rows, rows[0], (99, None, dt.date(2001, 1, 1))], "k int, start date, end date")
    assert {x.k: x.months for x in profiles.months_covered(spans, "k").collect()} == {k: len(v) for k, v in want.items()}
    merged: dict[int, set] = {}
    for x in profiles.merged_spans(spans, "k").collect():
        assert not merged.setdefault(x.k, set()) & set(range(x["first"] - 1, x["last"] + 2))  # a gap between any two
        merged[x.k] |= set(range(x["first"], x["last"] + 1))
    assert {k: {m - 24000 for m in v} for k, v in merged.items()} == want
    assert "Generate" not in profiles.months_covered(spans, "k")._jdf.queryExecution().executedPlan().toString()
