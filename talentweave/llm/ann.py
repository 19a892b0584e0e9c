"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

Every vector is written as its length times a unit vector; the unit vector is rotated at random and only the signs
are kept, packed in 64-bit words, with two correction scalars: its length and the inner product of the unit vector
with its own code.  A query is rotated alike and rounded to a few bits a dimension, so that an inner product with
a code is a handful of bit counts.  The estimate's error bound tells which vectors can still be among the nearest;
only those are compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import give_back, partitions, written

#: Bits to which a rotated query is rounded.
QUERY_BITS = 6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


#: Vectors and queries whose length lies outside are compared exactly: products of others neither overflow nor vanish.
TINY, HUGE = 1e-140, 1e140


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths, also where squares would overflow or vanish."""
    top = np.maximum(np.abs(vectors).max(1), np.finfo(float).tiny)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1))


def codes(vectors: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (n, words), lengths, and each unit vector's inner product with its code."""
    n, dim = vectors.shape
    scaled = vectors / np.maximum(np.abs(vectors).max(1), np.finfo(float).tiny)[:, None]
    turned = (scaled / np.sqrt((scaled * scaled).sum(1))[:, None]) @ rotate
    bits = np.zeros((n, -(-dim // 64) * 64), bool)
    bits[:, :dim] = turned > 0
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return packed, lengths_of(vectors), np.abs(turned).sum(1) / np.sqrt(dim)


@dataclass
class Block:
    """Vectors with their ids and their part of the index: codes, lengths, corrections."""

    ids: np.ndarray
    vectors: np.ndarray
    packed: np.ndarray
    norms: np.ndarray
    fit: np.ndarray


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, block: Block, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, score) of each query's k nearest in the block, by estimate and reranking.

    Rows of the query's own id are never among them.  Scores are inner products in double precision; one that is no
    number comes last.
    """
    vectors, ids, norms, fit = block.vectors, block.ids, block.norms, block.fit
    n, dim = vectors.shape
    rotate = rotation(dim)
    words, levels, root = block.packed.shape[1], (1 << QUERY_BITS) - 1, np.sqrt(dim)
    columns = [np.ascontiguousarray(block.packed[:, w]) for w in range(words)]
    ones = np.bitwise_count(block.packed).sum(1).astype(float)
    odd = (norms < TINY) | (norms > HUGE)
    usual = np.where(odd, 1.0, norms)
    # score = length * estimate, with an error of at most length * (bound * spread + rounding) but for few cases
    gain = usual / fit / root
    spread = bound * usual * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(dim - 1, 1))
    single = vectors.astype(np.float32) if not odd.any() and norms.max(initial=0) < 1e15 else None
    out_q, out_v, out_s = [], [], []
    order = np.argsort(ids, kind="stable")
    lows, highs = np.searchsorted(ids[order], query_ids, "left"), np.searchsorted(ids[order], query_ids, "right")
    for i, (query, length) in enumerate(zip(queries, lengths_of(queries), strict=True)):
        own = order[lows[i] : highs[i]]
        left = n - len(own)
        if left <= k or not TINY <= length <= HUGE:
            chosen = np.arange(n)
        else:
            turned = (query / length) @ rotate
            low = turned.min()
            step = max((turned.max() - low) / levels, 1e-12)
            rounded = np.rint((turned - low) / step).astype(np.uint64)
            dots = np.zeros(n, np.uint16 if dim << QUERY_BITS < 1 << 16 else np.uint32)
            for b in range(QUERY_BITS):
                plane = np.zeros(words * 64, bool)
                plane[:dim] = rounded >> np.uint64(b) & np.uint64(1)
                mask = np.packbits(plane, bitorder="little").view(np.uint64)
                for w in range(words):
                    hits = np.bitwise_count(columns[w] & mask[w]).astype(dots.dtype)
                    hits <<= b
                    dots += hits
            # sum over dimensions of (2 * bit - 1) * (low + step * rounded)
            signed = dots * (2 * step)
            signed += (2 * low) * ones
            signed -= low * dim + step * float(rounded.sum())
            signed *= gain
            slack = spread + gain * (step * root * 0.75)
            signed -= slack
            signed[odd] = -np.inf
            signed[own] = -np.inf
            cut = np.partition(signed, n - k)[n - k]  # k vectors are at least so near
            signed += 2 * slack
            signed[odd] = np.inf
            signed[own] = -np.inf
            chosen = np.flatnonzero(signed >= cut)
            if len(chosen) > 8 * k and single is not None:  # the exact k-th score of the likeliest replaces the bound of the k-th
                chosen = chosen[signed[chosen] > -np.inf]
                first = chosen[np.argpartition(signed[chosen], len(chosen) - 4 * k)[-4 * k :]]
                known = (vectors[first] * query[None]).sum(1) / length
                known = np.partition(known, len(known) - k)[len(known) - k]
                chosen = chosen[signed[chosen] >= max(cut, known - 1e-5 * abs(known))]
                if len(chosen) > k and length < 1e15:  # single precision first: its error is far below the margin
                    rough = single[chosen] @ query.astype(np.float32)
                    margin = 1e-5 * length * norms[chosen].max()
                    chosen = chosen[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - margin]
        chosen = chosen[ids[chosen] != query_ids[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (vectors[chosen] * query[None]).sum(1)
        best = np.lexsort((ids[chosen], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_v.append(chosen[best])
        out_s.append(score[best])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_v]), np.concatenate([np.zeros(0), *out_s])


def valid(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that take part: id and vector not null, all components finite, not all zero; with the dimension.

    Extra columns, whatever their names, are left out.
    """
    v = F.col("v")
    rows = df.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & F.col("id").isNotNull() & fine & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def index(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, dim, code, norm, fit) of every row that takes part: codes and corrections, made once from each vector."""
    rows = valid(vectors, id_, vector)
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            code, norm, fit = np.empty(len(dims), object), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                packed, norm[at], fit[at] = codes(_matrix(pa.chunked_array([batch.column(1).take(pa.array(at))]), dim), rotation(dim))
                code[at] = [x.tobytes() for x in packed]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(code, pa.binary()), pa.array(norm), pa.array(fit)],
                ["id", "v", "dim", "code", "norm", "fit"]
            )

    return rows.mapInArrow(run, f"id long, v {kind}, dim int, code binary, norm double, fit double")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, bound: float = 2.5, id_: str = "vec_id", vector: str = "embedding",
    block_bytes: int = 24 << 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every vector whose id is divisible by ``every``.

    The index is written once.  Blocks of its rows meet blocks of queries, each of about ``block_bytes``: a vector
    is sent once for every block of queries, a query once for every block of vectors.  Each meeting gives at most k
    rows a query, and a window picks the k best of them (ties to the smaller id).  Vectors that are null, zero or
    not finite take no part; vectors of different dimensions are not compared; rows that share an id are candidates
    in their own right, except for that id's query, which is the least of their vectors.  Lengths of any finite size
    are fine: extreme ones are compared without estimate, and products beyond double precision are infinite or no
    number, as that precision has it.  ``bound`` is the width of the error bound in standard errors: larger reranks
    more and misses less.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = index(vectors, id_, vector).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = written(rows, "index")
    sizes = rows.agg(
        F.count("*").alias("n"), F.sum(F.col("dim") * 8).alias("b"), F.count_if(F.col("id") % every == 0).alias("q"),
        F.sum(F.when(F.col("id") % every == 0, F.col("dim") * 8)).alias("qb")
    ).first()
    if not sizes["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(-(-sizes["b"] // block_bytes), min(partitions(spark), -(-sizes["n"] // 8192)))
    query_blocks = -(-sizes["qb"] // block_bytes)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.v", "q.dim")
    number = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    all_ = number(F.col("salt"), blocks)
    left = rows.select("id", "v", "dim", "code", "norm", "fit", all_.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = asked.select(
        F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("dim").alias("q_dim"),
        number(F.xxhash64("id"), query_blocks).alias("q_q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q_b")
    )

    def search(mine: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if mine.num_rows and queries.num_rows:
            dim = mine.column("dim")[0].as_py()
            packed = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint64).reshape(mine.num_rows, -1)
            block = Block(
                mine.column("id").to_numpy(), _matrix(mine.column("v"), dim), packed, mine.column("norm").to_numpy(),
                mine.column("fit").to_numpy()
            )
            ids = queries.column("q_id").to_numpy()
            qi, vi, score = nearest_in_block(_matrix(queries.column("q_v"), dim), ids, block, k, bound)
            found = [ids[qi], block.ids[vi], score]
        give_back()
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    met = left.groupBy("dim", "b", "q").cogroup(right.groupBy("q_dim", "q_b", "q_q")).applyInArrow(search, "query_id long, vec_id long, score double")
    nan_last = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(nan_last), F.isnan("score"), "vec_id"))
    return met.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
