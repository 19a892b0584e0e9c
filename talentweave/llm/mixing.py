"""Mixing sources to target weights by hash thresholds.

Sizes are summed by source and hash bucket.  A running sum over the buckets of a source finds the bucket in which
its budget ends; only the rows of that bucket are summed again, by the next bits of the hash, and at last by the
whole hash.  What lies below the thresholds is taken: no row is sorted, and the same rows are taken at each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import only, written

#: Bits of the hash used by the first and the second histogram.
BITS = 12
#: A per-source table of at most so many rows is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: ``amount`` of all sizes shared by weight, each at most ``most`` times its size."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    out, left, open_ = {}, amount * sum(sizes.values()), list(order)
    while open_:
        per = left / sum(weight[x] for x in open_)
        over = [x for x in open_ if per * weight[x] > most * sizes[x]]
        if not over:
            out |= {x: per * weight[x] for x in open_}
            break
        for x in over:
            out[x] = most * sizes[x]
            left -= out[x]
        open_ = [x for x in open_ if x not in out]
    return out


def targets_of(sizes: DataFrame, weights: tuple[float, ...], amount: float, most: float) -> DataFrame:
    """(sk, name, source_size, target): ``shares`` for any number of sources (name, source_size).

    Sources are ranked by ranges of names, and what a unit of weight gets is found from sums: a source is full if
    ``most`` times its size is less than its weight's part, and what the full ones leave raises the part of the others.
    The driver holds a few numbers a round and one a partition.
    """
    spark = sizes.sparkSession
    dealt = sizes.repartitionByRange(F.col("name").isNull(), F.col("name")).withColumn("part", F.spark_partition_id())
    dealt = written(dealt.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy(F.col("name").isNull(), "name"))), "ranked")
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    ranked = dealt.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
    sk = (F.col("before") + F.col("no") - 1).alias("sk")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sk"), F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select(sk, "name", "source_size").withColumn("weight", weight), "weighted")
    full = most * F.col("source_size")
    whole, level, n_full = amount * (ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        is_full = full < F.lit(level) * F.col("weight")
        r = ranked.agg(
            F.count_if(is_full).alias("n"), F.sum(F.when(is_full, full).otherwise(0.0)).alias("taken"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if r["n"] == n_full or not r["open"]:
            break
        n_full, level = r["n"], (whole - r["taken"]) / r["open"]
    return ranked.select("sk", "name", "source_size", F.least(full, F.lit(level) * F.col("weight")).alias("target"))


def _crossing(rows: DataFrame, bucket: F.Column, budgets: DataFrame) -> DataFrame:
    """(sk, bound, rest): the bucket of each source in which its budget ends, and what is left for that bucket."""
    sums = rows.select("sk", bucket.alias("bound"), "size").groupBy("sk", "bound").agg(F.sum("size").alias("held"))
    run = F.sum("held").over(Window.partitionBy("sk").orderBy("bound").rowsBetween(Window.unboundedPreceding, 0))
    seen = sums.withColumn("upto", run).join(budgets.hint("merge"), "sk")
    return seen.where("upto >= rest and upto - held < rest").select("sk", "bound", (F.col("rest") - F.col("upto") + F.col("held")).alias("rest"))


def row_hash(key: F.Column, text: F.Column) -> F.Column:
    """The first 64 bits of the MD5 of a row's key and text; nulls count as empty."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 16), 16, -10).cast("long")


def _with_size(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with columns mix_size and mix_hash added."""
    return documents.withColumns({"mix_size": word_count(f"`{text}`"), "mix_hash": row_hash(F.col(f"`{key}`"), F.col(f"`{text}`"))})


def thresholds(
    documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0, key: str = "doc_id",
    text: str = "text", source: str = "source"
) -> tuple[DataFrame, bool]:
    """One row a source: name, source_size, target, whole passes, and where its last, partial pass ends.

    b1 and b2 are the boundary buckets of the first and second histogram, b3 the hash at the boundary, ``missing``
    what the rows of that hash have to give of their ``tied`` words.  Also whether the table may be broadcast.
    """
    spark = documents.sparkSession
    rows = _with_size(only(documents, key, source, text).toDF("doc_id", "source", "text"), "doc_id", "text")
    rows = written(rows.select("source", F.col("mix_size").alias("size"), F.col("mix_hash").alias("h")), "sizes")
    sizes = written(rows.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size")), "sources")
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    near = F.broadcast if few else (lambda df: df.hint("merge"))
    if few:
        held = {r["name"]: r["source_size"] for r in sizes.collect()}  # at most BROADCAST_SOURCES rows
        targets = shares(held, weights, amount, most)
        sources = spark.createDataFrame(
            [(i, name, size, float(targets[name])) for i, (name, size) in enumerate(held.items())],
            "sk long, name string, source_size long, target double"
        )
    else:
        sources = targets_of(sizes, weights, amount, most)
    size = F.col("source_size")
    passes = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(int(most)))).otherwise(0).cast("int")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.when(size > 0, F.col("target") - F.col("passes") * size).otherwise(0.0))
    rows = rows.join(near(sources.select("sk", "name")), rows["source"].eqNullSafe(sources["name"])).select("sk", "size", "h")
    first, second = _bits("h")

    found1 = written(_crossing(rows, first, sources.where("rest > 0").select("sk", "rest")), "bound")
    inside = rows.join(near(found1.select("sk", F.col("bound").alias("b1"))), "sk").where(first == F.col("b1"))
    found2 = written(_crossing(inside, second, found1.select("sk", "rest")), "bound")
    inside = inside.join(near(found2.select("sk", F.col("bound").alias("b2"))), "sk").where(second == F.col("b2"))
    found3 = written(_crossing(inside, F.col("h"), found2.select("sk", "rest")), "bound")
    tied = inside.join(near(found3.select("sk", "bound")), "sk").where("h = bound").groupBy("sk").agg(F.sum("size").alias("tied"))
    out = sources.drop("rest").join(near(found1.select("sk", F.col("bound").alias("b1"))), "sk", "left")
    out = out.join(near(found2.select("sk", F.col("bound").alias("b2"))), "sk", "left")
    out = out.join(near(found3.join(tied, "sk").select("sk", F.col("bound").alias("b3"), F.col("rest").alias("missing"), "tied")), "sk", "left")
    return written(out, "thresholds"), few


def _bits(h: str) -> tuple[F.Column, F.Column]:
    return F.shiftrightunsigned(h, 64 - BITS), F.shiftrightunsigned(F.shiftleft(h, BITS), 64 - BITS)


def mixed_rows(
    documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0, whole: bool = False,
    key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The rows with mix_size, mix_source_size, mix_target and mix_taken added; nothing but the thresholds is moved."""
    bounds, few = thresholds(documents, weights, amount, most, key, text, source)
    names = ["source_size", "target", "passes", "b1", "b2", "b3", "missing", "tied"]
    bounds = bounds.select(F.col("name").alias("mix_name"), *[F.col(c).alias(f"mix_{c}") for c in names])
    rows = _with_size(documents, key, text)
    rows = rows.join(F.broadcast(bounds) if few else bounds.hint("merge"), F.col(f"`{source}`").eqNullSafe(F.col("mix_name")))
    size, h, (first, second) = F.col("mix_size"), F.col("mix_hash"), _bits("mix_hash")
    b1, b2, b3, missing, tied = (F.col(f"mix_{c}") for c in names[3:])
    part = F.when(F.lit(whole), F.when(2 * missing >= tied, size).otherwise(0)).otherwise(F.least(size, F.round(missing * size / tied).cast("long")))
    extra = (
        F.when(b1.isNull() | (first > b1), 0)
        .when(first < b1, size)
        .when(b2.isNull() | (second > b2), 0)
        .when(second < b2, size)
        .when(b3.isNull() | (h > b3), 0)
        .when(h < b3, size)
        .otherwise(part)
    )
    taken = F.least(F.col("mix_passes") * size + extra, (F.lit(most) * size).cast("long")).cast("long")
    return rows.withColumn("mix_taken", taken).drop("mix_name", "mix_hash", *[f"mix_{c}" for c in names[2:]])


def mix(
    documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0, whole: bool = False,
    key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row.

    ``taken`` is the row's words times its whole passes, plus its size again for rows below the source's
    threshold.  The one row at the threshold gives just the words that are missing (its first words); with
    ``whole`` it is taken if that comes nearer to the target.  Rows of the same hash of key and text (repeated
    rows) share what is missing by size.  Null or blank texts have size 0 and give nothing; null sources form one
    source, last in order; an empty table gives no rows.  Only the three named columns are read; the driver holds
    one number a source for at most BROADCAST_SOURCES of them, and none for more.
    """
    rows = mixed_rows(only(documents, key, source, text).toDF("doc_id", "source", "text"), weights, amount, most, whole)
    return rows.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken")
    )


def repeated(
    documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0, key: str = "doc_id",
    text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix itself: every row as often as the mix takes it (not at all, once, or more), with its columns."""
    rows = mixed_rows(documents, weights, amount, most, True, key, text, source)
    times = F.when(F.col("mix_size") > 0, F.floor(F.col("mix_taken") / F.col("mix_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("mix_times", times).where("mix_times > 0")
    return rows.withColumn("mix_time", F.explode(F.array_repeat(F.lit(1), F.col("mix_times")))).select(*[F.col(f"`{c}`") for c in documents.columns])
