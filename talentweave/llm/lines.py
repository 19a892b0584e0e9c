"""Lines that stand in several documents, kept in the first of them only.

Lines are exploded and normalised, and their hashes counted over distinct documents.  Positions of lines to drop go
back to their document, which puts the others together again by position.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import only, rows_by_text, written

#: What is stripped at the ends of a line: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: F.Column) -> F.Column:
    """The line without blanks at its ends and with A-Z, and no other letter, lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII alone, where lower() changes A-Z only and is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def without_repeated_lines(documents: DataFrame, chars: int = 10, least: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row: its lines but those that another document holds first.

    A line of at least ``chars`` code points (stripped) that stands in ``least`` or more documents stays only in the
    document of the smallest id among them, there as often as it stands.  Rows of one id are one document; rows
    without an id come last and are told apart by their texts.  Null and empty texts are one empty line; repeated
    rows are treated alike; an empty table gives no rows; other columns are left behind.

    Hashes of 128 bits stand for lines and for rows.  Counting combines on the map side, also for a line that a third
    of all documents hold; the joins that bring marks back have two plain exchanges, so that adaptive execution
    splits such a line.  Texts are shuffled once.
    """
    rows = rows_by_text(only(documents, key, text).toDF("doc_id", "text"))
    lines = rows.select("doc_id", "k1", "k2", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= chars)
    other = F.when(F.col("doc_id").isNull(), F.col("k1"))
    lines = lines.select("doc_id", other.alias("other"), "k1", "k2", "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))
    held = lines.groupBy("h1", "h2").agg(
        F.count_distinct(F.coalesce("doc_id", F.lit(0)), F.coalesce("other", F.lit(0)), F.col("doc_id").isNull()).alias("n"),
        F.min("doc_id").alias("first_id"), F.min("other").alias("first_other")
    ).where(F.col("n") >= least)
    first = F.when(F.col("first_id").isNull(), F.col("other") == F.col("first_other")).otherwise(F.col("doc_id").eqNullSafe(F.col("first_id")))
    held = written(held, "held")  # of its own, so that both sides of the join have a plain exchange
    drops = lines.join(held.hint("merge"), ["h1", "h2"]).where(~first).groupBy("k1", "k2").agg(F.collect_set("pos").alias("drops"))
    rows = rows.join(drops.hint("merge"), ["k1", "k2"], "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drops"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped")
    )
