"""Ranking that leaves out blocks of postings of which none can be among a profile's best.

Postings are dealt to blocks by the pivot that they are nearest to and by how near.  A block's bounds are those of its
three scores: the cosine by the angles between profile, pivot and postings, skills by the names that occur, experience by
the fewest years asked for.  The most promising blocks of a profile give a score that its k-th best has at least; blocks
whose bound is below it are never looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talentweave.operators import matching
from talentweave.operators.sizes import settled

#: Vectors that postings are dealt by (so many postings of smallest hash), rings of nearness about each, postings to a block.
PIVOTS, RINGS, PER_BLOCK = 64, 16, 1024
#: Blocks of a profile that are searched before any is left out.
PROBES = 2


def in_blocks(postings: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``postings`` with block b, pivot and cosine to it; no block has more than some PER_BLOCK, however many are alike."""
    unit = matching.unit(pivots)

    @F.pandas_udf("pivot int, nearness double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        rows = np.zeros((len(vectors), unit.shape[1]))
        for row, v in zip(rows, vectors, strict=True):
            if v is not None and len(v) == len(row):
                row[:] = v
        found = matching.unit(rows) @ unit.T
        best = found.argmax(axis=1)
        return pd.DataFrame({"pivot": best.astype(np.int32), "nearness": found[np.arange(len(rows)), best]})

    rows = postings.withColumn("_n", nearest(F.col("embedding").cast("array<double>"))).select(*postings.columns, "_n.pivot", "_n.nearness")
    ring = F.least(F.floor((F.col("nearness") + 1) / 2 * RINGS), F.lit(RINGS - 1)).cast("int")
    rows = settled(rows.withColumn("cell", F.col("pivot") * RINGS + ring), "cells")
    # at most PIVOTS x RINGS rows
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    begin, sizes = 0, []
    for cell, n in sorted(counts.items()):
        parts = -(-n // PER_BLOCK)
        sizes.append((cell, begin, parts))
        begin += parts
    table = rows.sparkSession.createDataFrame(sizes, "cell int, begin int, parts int")
    rows = rows.join(F.broadcast(table), "cell")
    return rows.withColumn("b", F.col("begin") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("cell", "begin", "parts")


def block_table(postings: DataFrame) -> DataFrame:
    """(b, pivot, low, high, years, bare, held): what a block's bounds depend on."""
    return postings.groupBy("b").agg(
        F.first("pivot").alias("pivot"), F.min("nearness").alias("low"), F.max("nearness").alias("high"),
        F.min(F.coalesce(F.col("experience_years").cast("double"), F.lit(0.0))).alias("years"), F.bool_or(F.size("names") == 0).alias("bare"),
        F.array_distinct(F.flatten(F.collect_set("names"))).alias("held"),
    )


def _at_most(people: pa.Table, blocks: pa.Table, pivots: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Upper bounds of the scores of all blocks (rows) for all profiles (columns)."""
    column = lambda t, c: np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False).astype(float))
    to_pivot = np.arccos(np.clip(matching.unit(matching.vector_rows(people.column("p_e"), pivots.shape[1])) @ matching.unit(pivots).T, -1, 1))
    angle = to_pivot[:, blocks.column("pivot").to_numpy()].T
    near, far = (np.arccos(np.clip(column(blocks, c), -1, 1))[:, None] for c in ("high", "low"))
    apart = np.maximum(0, np.maximum(near - angle, angle - far))
    best = weights["embedding"] * np.maximum(0, np.cos(np.minimum(apart, np.pi)))
    covered, held = people.column("p_covered").to_pylist(), blocks.column("held").to_pylist()
    place = {x: i for i, x in enumerate(sorted({x for xs in covered for x in xs}))}
    has, names = np.zeros((len(place), len(covered)), np.float32), np.zeros((len(held), len(place)), np.float32)
    for j, xs in enumerate(covered):
        has[[place[x] for x in xs], j] = 1
    for i, xs in enumerate(held):
        names[i, [place[x] for x in xs if x in place]] = 1
    blank = np.outer(blocks.column("bare").to_numpy(zero_copy_only=False), people.column("p_any").to_numpy(zero_copy_only=False)) * 0.5
    best += weights["skill"] * np.where(names @ has > 0, 1.0, blank)
    wanted, have = column(blocks, "years")[:, None], column(people, "p_years")[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(have <= 0, 0.0, np.minimum(have / wanted, 1.0))
    return best + weights["experience"] * np.where(wanted <= 0, 1.0, part) + 1e-9


def bounds(people: DataFrame, blocks: DataFrame, pivots: np.ndarray, weights: dict[str, float], asks: int) -> DataFrame:
    """(p_profile_id, b, bound) of all profiles and blocks: one row for some PER_BLOCK pairs."""
    spark = people.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    kind = people.schema["p_profile_id"].dataType
    profile_type = to_arrow_type(kind)

    def work(some: pa.Table, who: pa.Table) -> pa.Table:
        if not some.num_rows or not who.num_rows:
            return pa.table({"p_profile_id": pa.array([], profile_type), "b": pa.array([], pa.int32()), "bound": pa.array([], pa.float64())})
        bound = _at_most(who, some, pivots, weights)
        b, p = (x.ravel() for x in np.indices(bound.shape))
        return pa.table({"p_profile_id": who.column("p_profile_id").take(pa.array(p)), "b": some.column("b").take(pa.array(b)), "bound": pa.array(bound.ravel())})

    left = blocks.withColumns({"g": matching.dealt_to(F.col("b"), parts), "q": F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))})
    right = people.withColumn("p_g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("g", "q").cogroup(right.groupBy("p_g", "p_q")).applyInArrow(work, f"p_profile_id {kind.simpleString()}, b int, bound double")


def bounded_matches(
    profiles: DataFrame, postings: DataFrame, k: int = 20, skill_pairs: DataFrame | None = None,
    weights: dict[str, float] | None = None, order: tuple[str, ...] = ("last_seen_at", "id"), digits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same rows as ``matching.best_matches``, and (profile_id, blocks, searched): how many blocks there are, and were searched.

    Exact at any input: a block is left out only if its bound is below a score that k postings of the profile have.
    Postings of null or zero vectors are in blocks like any other.  Tables on the way are written to the shared folder.
    """
    w = matching.normalized_weights(weights)
    margin = 1e-9 + (10.0**-digits if digits is not None else 0.0)
    profiles, postings, name = matching.prepared(profiles, postings, skill_pairs)
    sample = postings.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select(F.col("embedding").cast("array<double>").alias("e"))
    vectors = [r["e"] for r in sample.collect()]
    dim = max(map(len, vectors), default=1)
    pivots = np.array([v for v in vectors if len(v) == dim] or [[0.0] * dim])
    given = settled(in_blocks(matching.named(postings, name), pivots), "blocks")
    asks = max(1, -(-profiles.count() // (8 * matching.BLOCK)))
    left, people = matching.search_rows(profiles, given, order, asks)
    limits = settled(bounds(people, block_table(given), pivots, w, asks), "bounds")
    limits = limits.withColumn("n", F.row_number().over(Window.partitionBy("p_profile_id").orderBy(F.desc("bound"), "b")))

    def search(wanted: DataFrame) -> DataFrame:
        asked = wanted.select("p_profile_id", F.col("b").alias("p_b")).hint("merge").join(people, "p_profile_id")
        return matching.searched(left, asked, k, w, order, margin)

    first = settled(search(limits.where(F.col("n") <= PROBES)), "first")
    kth = first.withColumn("n", F.row_number().over(Window.partitionBy("p_profile_id").orderBy(F.desc("score")))).where(F.col("n") == k)
    limits = limits.join(kth.select("p_profile_id", F.col("score").alias("least")).hint("merge"), "p_profile_id", "left")
    open_ = F.col("least").isNull() | (F.col("bound") >= F.col("least") - margin)
    limits = settled(limits.withColumn("open", (F.col("n") <= PROBES) | open_), "limits")
    found = first.unionByName(search(limits.where((F.col("n") > PROBES) & F.col("open"))))
    visited = limits.groupBy(F.col("p_profile_id").alias("profile_id")).agg(F.count("*").alias("blocks"), F.count_if("open").alias("searched"))
    return matching.ranked_rows(profiles, postings, found, name, w, k, order, digits, margin), visited
