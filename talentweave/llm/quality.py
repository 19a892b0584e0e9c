"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word has a sparse random index vector, fixed by its hash.  A word's context vector is the sum of the index
vectors of its neighbours over the whole corpus (words share ``BUCKETS`` rows by hash, so the table is bounded).
A document's vector is the mean of its words' context vectors, beside the mean of the index vectors of its words'
shapes (case, last sign, length, signs, whether it repeats the word before).  A network of two layers, in numpy,
is fitted on a bounded sample of labelled rows, and its temperature on a part of them that it has not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import concatenated, map_slices, only, slices, span_hashes, words_of

BUCKETS, DIMS, NONZERO = 4096, 64, 4
#: At most so many labelled rows are learnt from: those of the smallest hashes.
SAMPLE = 6000

_TAIL = np.zeros(256, np.int64)
for _signs, _kind in ((b".", 1), (b",;:", 2), (b"!?", 3), (b"*&%$#@^~=+<>", 4), (b"|/\\_-", 5), (b"0123456789", 6), (b"\"'()[]{}`", 7)):
    _TAIL[list(_signs)] = _kind
_UPPER, _LOWER = np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_SIGN = (_TAIL > 0).astype(np.int32)
_SIGN[48:58] = 0
SHAPES = 4 * 8 * 2 * 4 * 3


def _index(rows: int, seed: int) -> np.ndarray:
    """Sparse random index vectors for the shapes."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


SHAPE_INDEX = _index(SHAPES, 11)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, first = concatenated(texts)
    starts, ends = words_of(data)
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(first, starts, side="right") - 1, first


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, of: np.ndarray) -> np.ndarray:
    def among(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[ends] - sums[starts]

    upper, lower, signs = among(_UPPER), among(_LOWER), among(_SIGN)
    case = np.where(upper == 0, 0, np.where(lower > 0, np.where((upper == 1) & (_UPPER[data[starts]] == 1), 1, 3), np.where(upper > 1, 2, 1)))
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    size = np.minimum((ends - starts) // 4, 3)
    return (((case * 8 + _TAIL[data[ends - 1]]) * 2 + again) * 4 + size) * 3 + np.minimum(signs, 2)


def context_sums(documents: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIMS): for each bucket of words, the sum of the index vectors of all neighbours in the corpus.

    Each task adds up its own rows; the sums of the cells are what is shuffled, and reach the driver once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMS)
        for _, texts in slices(batches):
            _, _, _, h, of, _ = _words(texts)
            row = (h % np.uint64(BUCKETS)).astype(np.int64) * DIMS
            near = of[1:] == of[:-1]
            for mine, other in ((row[:-1][near], h[1:][near]), (row[1:][near], h[:-1][near])):
                for j in range(NONZERO):
                    at = (other >> np.uint64(20 + 6 * j) & np.uint64(DIMS - 1)).astype(np.int64)
                    sign = (other >> np.uint64(50 + j) & np.uint64(1)).astype(np.float64) * 2 - 1
                    total += np.bincount(mine + at, weights=sign, minlength=BUCKETS * DIMS)
        cells = np.flatnonzero(total)
        for s in range(0, len(cells), 1 << 16):
            c = cells[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(total[c])], ["cell", "v"])

    sums = only(documents, text).toDF("text").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(BUCKETS * DIMS)
    got = sums.toArrow()  # at most BUCKETS * DIMS rows
    out[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(BUCKETS, DIMS)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Each text's vector: mean context vector, mean shape index vector, and log length; zeros if it has no words."""
    data, starts, ends, h, of, _ = _words(texts)
    n = len(texts)
    out = np.zeros((n, 2 * DIMS + 1), np.float32)
    if not len(h):
        return out
    count = np.bincount(of, minlength=n)
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    begin = np.searchsorted(of, np.arange(0, n + 64, 64))
    for i, (lo, hi) in enumerate(zip(begin, begin[1:], strict=False)):  # the counts of some texts at a time
        t = out[64 * i : 64 * i + 64]
        words = np.bincount((of[lo:hi] - 64 * i) * BUCKETS + bucket[lo:hi], minlength=len(t) * BUCKETS).reshape(len(t), BUCKETS)
        t[:, :DIMS] = words.astype(np.float32) @ vectors
    shape = np.bincount(of * SHAPES + _shapes(data, starts, ends, h, of), minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, DIMS : 2 * DIMS] = shape.astype(np.float32) @ SHAPE_INDEX
    out[:, : 2 * DIMS] /= np.maximum(count, 1)[:, None]
    out[:, -1] = np.log1p(count) / 10
    return out


@dataclass
class Network:
    """Scores of pooled vectors; ``prior`` alone if there was nothing to learn from."""

    vectors: np.ndarray
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        z = self.logits(pooled(texts, self.vectors).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, rounds: int = 400, seed: int = 3) -> Network:
    """Two layers by Adam on four fifths of the rows, the temperature on the last fifth."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2 or len(y) < 20:
        return Network(vectors, prior)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    z = (x - mean) / scale
    w = [
        rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
        rng.standard_normal(hidden) * np.sqrt(2 / hidden), np.zeros(())
    ]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, rounds + 1):
        batch = rng.choice(learn, min(512, len(learn)), replace=False)
        a, t = z[batch], y[batch]
        h = np.maximum(a @ w[0] + w[1], 0)
        g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -60, 60))) - t) / len(batch)
        back = g[:, None] * w[2][None] * (h > 0)
        grads = [a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum()]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, prior, mean, scale, tuple(w))
    logits, truth = net.logits(x[held].astype(np.float64)), y[held]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    losses = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean() for t in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


def _crc_third(key: F.Column) -> F.Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Fit on at most ``sample`` labelled rows whose crc32(key as text) mod 3 is not 1; corpus sums cover all rows.

    Labels other than 0 and 1, and null keys, are left out; of repeated labels of a key one is kept.
    """
    known = only(labels, key, label).toDF("doc_id", "y").where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (_crc_third(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = documents.sparkSession.createDataFrame(known.collect(), "doc_id long, y int")  # at most `sample` rows
    vectors = context_sums(documents, text)
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    vectors = (vectors / np.maximum(length, 1e-9)).astype(np.float32)
    chosen = only(documents, key, text).toDF("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        x = pooled(texts, vectors)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
            ["doc_id", "y", "x"]
        )

    rows = map_slices(
        chosen.select("doc_id", "y", "text"), run, "doc_id long, y int, x array<float>"
    ).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return Network(vectors, 0.5)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return fit(x.astype(np.float64), rows.column("y").to_numpy().astype(np.float64), vectors)


def score(documents: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and blank texts are scored as documents without words; repeated rows get equal scores; an empty table
    gives no rows; a null key counts as an empty one for held_out.  Only the two named columns are read.
    """

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        p = network.scores(texts)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    out = map_slices(only(documents, key, text).toDF("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", (_crc_third(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(documents: DataFrame, network: Network, at_least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``at_least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            yield part.filter(pa.array(network.scores(texts) >= at_least))

    return documents.mapInArrow(run, documents.schema)
