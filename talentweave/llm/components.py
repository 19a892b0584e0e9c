"""Connected components of a link table by DataFrame rounds: least-label spreading with shortcuts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import discard, written


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as (node, least node of its component), one for each node but the least ones."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the least node reachable.

    Each round gives every node the least label among its neighbours' and its own, then follows labels once
    (so chains shorten by more than half a round).  Rounds go through tables in the shared folder; the driver
    sees one number a round, and a round's tables go when the next is written.  In every join one side has one row a
    node and comes from an exchange of its own, so adaptive execution can split a hub's links or a large group.  Null nodes, loops and repeated links add nothing; no links give no rows.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both = written(
        links.select(
            F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
        ).select("e.*").distinct(),
        "links"
    )
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.hint("merge").join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.hint("merge").join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        step = written(step, "step")
        # the old label's own node hears of the lower label too, as in union by least root
        told = step.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("told"))
        lower = step.hint("merge").join(told, "node", "left").select("node", "label", F.least("low", F.coalesce("told", "low")).alias("low"))
        # the side that is looked up is read from the table anew, so that a label of very many nodes can be split
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = lower.hint("merge").join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "label")
        new = written(new.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        discard(labels, step)
        labels = new.select("node", "label")
        labels.scratch_path = new.scratch_path
        if not new.where("moved").limit(1).count():
            discard(both)
            return new.select("node", F.col("label").alias("component"))
