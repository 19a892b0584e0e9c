"""Pairs of sets that can have a Jaccard similarity, by their rarest members.

Members are ordered from the rarest on.  Of two sets of sizes m <= n whose similarity is at least s, which then share
at least s / (1 + s) (m + n) members, the first one that they share must have as many left from its place on, in both
sets.  So only few members of a set need be looked up: ``n - s n + 1`` of the larger one, and ``m - 2 s / (1 + s) m + 1``
of the smaller one.  Sets made of one template and a share of their own, too large for the similarity, never meet: the
template's members stand too late in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import discard, give_back, written


def members(sets: DataFrame) -> DataFrame:
    """(node, member) of sets (node, shingles: packed 64-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(packed.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], ["node", "member"])
        give_back()

    return sets.select("node", "shingles").mapInArrow(run, "node long, member long")


def entries(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(member, node, n, label, most, strong): the members by which a set may meet another, and the sizes it may meet.

    ``nodes`` has node, n (the set's size) and label.  A partner has at most ``most`` members; an entry is strong if
    the set can meet another of its size or more by it.  Members of one set only can meet nothing, and are left out;
    they stand first in the order.
    """
    each = written(members(sets), "members")
    several = written(each.groupBy("member").agg(F.count("*").alias("df")).where(F.col("df") > 1), "several")
    held = each.hint("merge").join(several, "member").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "member"))).alias("held"))
    rows = held.hint("merge").join(nodes.select("node", "n", "label"), "node")
    # a member at place i of those held has size(held) - i left, itself included
    first = F.greatest(F.lit(0), F.size("held") - F.ceil(similarity * F.col("n") - F.lit(1e-6)) + 1).cast("int")
    rows = rows.select("node", "n", "label", F.size("held").alias("size"), F.posexplode(F.slice("held", F.lit(1), first)).alias("i", "x"))
    most = F.floor((F.col("size") - F.col("i")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6).cast("long")
    rows = rows.select(F.col("x.member").alias("member"), "node", "n", "label", most.alias("most"), (most >= F.col("n")).alias("strong"))
    out = written(rows, "entries")
    discard(each, several)
    return out


def candidates(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of sets with other labels that may have the similarity, each once.

    Members whose sets all have one label, or none of them strong, go before the join, by a count that combines on the
    map side; both sides of the joins come from tables, so that adaptive execution splits a frequent member.
    """
    all_ = entries(sets, nodes, similarity)
    wide = all_.groupBy("member").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("strong").alias("strong"))
    wide = written(wide.where("lo <> hi and strong").select("member"), "wide")
    met = written(all_.hint("merge").join(wide, "member", "left_semi"), "met")
    one = met.where("strong").select("member", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "most")])
    two = met.select("member", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "most")])
    fits = "n_b >= n_a and n_b <= most_a and n_a <= most_b and label_a <> label_b and (n_b > n_a or node_b > node_a)"
    found = one.hint("merge").join(two, "member").where(fits).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    out = written(found.agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")), "candidates")
    discard(all_, wide, met)
    return out
