"""How filters applied one after the other act on each other, for all orders of them.

Whole texts are read once and become a mask of the filters they fail; only counts by part and mask go on.  In the
lexicographic list of all orders, the orders that begin with the same letters are neighbours.  So the orders in which
a mask is removed at a step are a few intervals of ranks: counts are added at the beginning of an interval and taken
off at its end, and running sums over the ranks give the totals of every order.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import only

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in itertools.permutations(FILTERS)]
KINDS = ("entered", "removed", "redundant", "unique_fails")


def failing(text: F.Column, words: F.Column) -> list[F.Column]:
    """Conditions of filters A to D for a text and the array of its words."""
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def intervals() -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(mask, step, begin, end, one number for each of KINDS): ranks of the orders in which a mask counts at a step.

    The k-th beginning of ``step`` letters, in lexicographic order, is that of (5 - step)! orders from k (5 - step)! on.
    """
    found: dict[tuple, list[int]] = {}
    for step in range(1, len(FILTERS) + 1):
        size = math.factorial(len(FILTERS) - step)
        for k, letters in enumerate(itertools.permutations(range(len(FILTERS)), step)):
            for mask in range(1 << len(FILTERS)):
                fails = mask >> letters[-1] & 1
                before = any(mask >> x & 1 for x in letters[:-1])
                kinds = (1, int(fails and not before), int(fails and before), int(mask == 1 << letters[-1]))
                spans = found.setdefault((mask, step, kinds), [])
                if spans and spans[-1] == k * size:
                    spans[-1] += size  # goes on where the one before ends
                else:
                    spans += [k * size, (k + 1) * size]
    return [(mask, step, *span, *kinds) for (mask, step, kinds), spans in found.items() for span in zip(spans[::2], spans[1::2], strict=True)]


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that fail just the filters of the mask, by bit from A on."""
    docs = only(documents, "doc_id", "text", "source").toDF("doc_id", "text", "part")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("part", F.lit("")).alias("part"))
    docs = docs.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing(F.col("text"), F.col("words")))]
    docs = docs.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    marked = only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
    marked = marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    docs = docs.join(marked.hint("merge"), "doc_id", "left").fillna(False, ["good", "toxic"])
    # equal texts: a few rows a text and part remain, each with its first id and the rows that have this id
    alike = ["h1", "h2", "part", "mask", "good", "toxic"]
    docs = docs.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    docs = docs.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first"))
    place = F.struct("first.none", "first.doc_id")
    docs = docs.withColumn("least", F.min(place).over(Window.partitionBy("h1", "h2")))
    kept = F.when(place == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    last = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct("mask", kept.alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - kept).alias("n"))))
    docs = docs.select("part", "good", "toxic", both.alias("x")).where("x.n > 0")
    count = lambda c: F.sum(F.when(c, F.col("x.n")).otherwise(0))
    return docs.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty and null sources the part ''.  A text fails E where a smaller id has the same text; rows
    without an id come after all others and don't precede each other; rows of the same id don't either, and count each.
    Labels that repeat count as marked if any of them is; labels without an id, or of no document, mark nothing.  An
    empty table gives no rows; other columns are left behind.

    Texts aren't shuffled: 128-bit hashes stand for them, and copies are combined on the map side.  The broadcast table
    of intervals is the same for all data.
    """
    spark = documents.sparkSession
    counts = masks(documents, labels)
    names = ", ".join(f"{k} long" for k in KINDS)
    spans = spark.createDataFrame(intervals(), f"mask int, step int, begin int, end int, {names}")
    each = counts.join(F.broadcast(spans), "mask")
    edges = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    each = each.withColumn("edge", edges)
    sums = {k: F.col(k) * F.col("n") for k in KINDS} | {f"{k}_lost": F.col("removed") * F.col(k) for k in ("good", "toxic")}
    steps = each.groupBy("part", "step", F.col("edge.rank").alias("rank")).agg(*[F.sum(F.col("edge.sign") * v).alias(k) for k, v in sums.items()])
    ranks = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"))
    ranks = ranks.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"), "rank", *[F.lit(0).cast("long").alias(k) for k in sums])
    steps = steps.unionByName(ranks).where(F.col("rank") < len(ORDERS)).groupBy("part", "step", "rank").agg(*[F.sum(k).alias(k) for k in sums])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "step", "rank", *[F.sum(k).over(along).alias(k) for k in sums])
    order = F.get(F.array(*[F.lit(x) for x in ORDERS]), F.col("rank"))
    steps = steps.withColumn("filter_order", order).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return steps.select(
        "part", "filter_order", "step", (F.col("entered") - so_far).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley")
    )
