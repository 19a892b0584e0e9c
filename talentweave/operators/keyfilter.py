"""Bitmaps of keys: a small table that tells of most rows of a large one that their key is not among some others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, 4 MB at most in all.  A filter of so many keys that a quarter of the bits is set still drops three of four rows.
BITS = 1 << 25


def _bit(keys: list[str]) -> Column:
    """The bit of a row's key, from 1 on."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(BITS)) + 1


def key_filter(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, bits): a Bloom filter of one hash over the keys of ``rows``, as at most BITS / 32,768 bitmaps of 4 KB.

    Bitmaps are combined on the map side, so each task sends no more than the filter's own size.
    """
    bit = _bit(keys)
    return rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def may_match(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key may be among those of the filter ``held``: all that are, and a few more; nothing is moved.

    The filter is broadcast; its size is bounded by BITS.  Keys with nulls are keys like any other.
    """
    place = F.bitmap_bit_position(_bit(keys))
    own = F.bitmap_bucket_number(_bit(keys))
    found = rows.withColumns({"_bucket": own, "_place": place}).join(
        F.broadcast(held.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))), "_bucket"
    )
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_ = F.expr("shiftright({byte}, cast(_place % 8 as int)) & 1 = 1".replace("{byte}", "_byte"))
    return found.withColumn("_byte", byte).where(set_).drop("_bucket", "_place", "_bits", "_byte")
