"""Document fingerprints from improbable features.

Every window of 64 bytes has an entropy; how seldom that entropy occurs in the whole corpus is its rank.  A window
that is the rarest of its 64 neighbours often enough is a feature.  Features go, in order, into a chain of Bloom
filters of 2048 bits, at most 160 a filter, five bits a feature.  Two fingerprints are compared filter by filter by
the overlap of their bits, normalised by the overlap that chance gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import map_slices, only, partitions, slices, span_hashes

WINDOW, POPULAR, BINS = 64, 16, 1024
BITS, FEATURES, PROBES = 2048, 160, 5
STEP_BYTES = 1 << 19
_UNIT = 1 << 20
#: count * log2(count) / WINDOW in units of 2**-20; entropy of a window is log2(WINDOW) less the sum of these.
_PART = np.array([0] + [round(c * np.log2(c) / WINDOW * _UNIT) for c in range(1, WINDOW + 1)], np.int64)
_FULL = round(np.log2(WINDOW) * _UNIT)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Bin (0 to BINS - 1) of the entropy of each window of data, by what leaves and what enters."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # same byte among the 63 before, and after
    for j in range(1, WINDOW):
        same = (data[j:] == data[:-j]).view(np.uint8)
        behind[j:] += same
        ahead[:-j] += same
    first = int(_PART[np.bincount(data[:WINDOW], minlength=256)].sum())
    out = np.empty(n - WINDOW + 1, np.int64)
    out[0] = first
    delta = np.diff(_PART)
    np.add.accumulate(delta[behind[WINDOW:]] - delta[ahead[: n - WINDOW]], out=out[1:]) if n > WINDOW else None
    out[1:] += first
    return np.clip((_FULL - out) * BINS // (_FULL + 1), 0, BINS - 1)


def bin_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """How many windows of the corpus fall into each entropy bin: at most BINS numbers reach the driver."""

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        total = np.zeros(BINS, np.int64)
        for some in _some(texts):
            data, valid, _ = _laid_out(some)
            total += np.bincount(entropy_bins(data)[valid], minlength=BINS)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    for r in map_slices(only(documents, text).toDF("text"), run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    return counts


def _some(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes, so that numpy works inside the processor's cache."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes together, a mask of the windows that lie in one text, and where the texts start (and end)."""
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    data = np.frombuffer(b"".join(texts), np.uint8)
    valid = np.ones(max(0, len(data) - WINDOW + 1), bool)
    for end in starts[1:-1].tolist():
        valid[max(0, end - WINDOW + 1) : end] = False
    return data, valid, starts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each bin, rarest first; equal counts by bin."""
    out = np.empty(BINS, np.int64)
    out[np.argsort(counts, kind="stable")] = np.arange(BINS)
    return out


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chosen windows in order, text after text, and how many each text has.

    A text shorter than a window is one feature, an empty one has none; a text with fewer windows than a
    neighbourhood, or none popular enough, gives its best window.
    """
    data, valid, starts = _laid_out(texts)
    lengths = np.diff(starts)
    key = np.full(len(valid), np.int64(BINS) << 40)
    rank = ranks[entropy_bins(data)]
    np.copyto(key, (rank << 40) | np.arange(len(rank)), where=valid)
    votes = np.zeros(len(key), np.int64)
    if len(key) >= WINDOW:
        low, ends_too, reach = key, valid, 1
        while reach < WINDOW:  # least key among the next WINDOW, by doubling, and whether all lie in one text
            low = np.minimum(low[: len(low) - reach], low[reach:])
            ends_too = ends_too[: len(ends_too) - reach] & ends_too[reach:]
            reach *= 2
        votes = np.bincount(low[ends_too] & ((1 << 40) - 1), minlength=len(key))
    chosen = np.flatnonzero(votes >= POPULAR)
    of = np.searchsorted(starts, chosen, side="right") - 1
    has = np.bincount(of, minlength=len(texts)) > 0
    more_at, more_to = [], []
    for i in np.flatnonzero(~has & (lengths > 0)).tolist():
        s, windows = starts[i], lengths[i] - WINDOW + 1
        if windows <= 0:
            more_at.append(s)
            more_to.append(starts[i + 1])
        else:
            best = s + int(np.argmax(votes[s : s + windows]) if windows >= WINDOW else np.argmin(key[s : s + windows]))
            more_at.append(best)
            more_to.append(best + WINDOW)
    at = np.concatenate([chosen, np.array(more_at, np.int64)])
    to = np.concatenate([chosen + WINDOW, np.array(more_to, np.int64)])
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    # an empty text starts where the next one does: side="right" gives the last, the one with bytes
    return span_hashes(data, at, to), np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(texts))[: len(texts)]


def fingerprints_of(texts: list[bytes], ranks: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Each text's chain of Bloom filters, as rows of 32 unsigned 64-bit numbers, and its number of features."""
    hashes, counts = features(texts, ranks)
    chains = -(-counts // FEATURES)
    first = np.concatenate([[0], np.cumsum(chains)])
    begin = np.concatenate([[0], np.cumsum(counts)])
    of = np.repeat(np.arange(len(texts)), counts)
    row = first[of] + (np.arange(len(hashes)) - begin[of]) // FEATURES
    bits = np.zeros((int(first[-1]), BITS), bool)
    for p in range(PROBES):
        bits[row, (hashes >> np.uint64(11 * p)) & np.uint64(BITS - 1)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64) if len(bits) else np.zeros((0, BITS // 64), np.uint64)
    return [(packed[first[i] : first[i + 1]], int(counts[i])) for i in range(len(texts))]


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """0 to 1: over the shorter chain's filters, the best normalised overlap in the other, weighted by features."""
    (fa, na), (fb, nb) = (a, b) if a[1] <= b[1] else (b, a)
    if not na:
        return 1.0 if not nb else 0.0
    if na == nb and np.array_equal(fa, fb):
        return 1.0
    ones_a, ones_b = np.bitwise_count(fa).sum(1).astype(float), np.bitwise_count(fb).sum(1).astype(float)
    weights = np.full(len(fa), FEATURES)
    weights[-1] = na - FEATURES * (len(fa) - 1)
    total = 0.0
    for i, x in enumerate(fa):
        both = np.bitwise_count(fb & x).sum(1)
        chance = ones_a[i] * ones_b / BITS
        most = np.minimum(ones_a[i], ones_b)
        floor = chance + 0.1 * (most - chance)
        total += weights[i] * max(0.0, float(((both - floor) / np.maximum(most - floor, 1e-9)).max()))
    return min(1.0, total / weights.sum())


def text_form(fp: tuple[np.ndarray, int]) -> str:
    return f"{fp[1]}:{fp[0].tobytes().hex()}"


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _constant(values: list, kind: str) -> F.Column:
    """An array as one literal of the plan, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def in_order(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, halo, doc_id, text): rows dealt to ranges of falling doc_id, each closed by a copy of the next range's
    first row (the last range by the first row of all), sorted within partitions."""
    spark = documents.sparkSession
    rows = only(documents, key, text).toDF("doc_id", "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = 4 * partitions(spark)
    cuts = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)))
    # two levels keep the search for a row's range short when there are many
    wide = max(1, int(len(cuts) ** 0.5))
    coarse = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    if cuts:
        group = F.aggregate(_constant([c[0] for c in coarse], "array<double>"), F.lit(0), lambda a, x: a + F.when(x <= at, 1).otherwise(0))
        rows = rows.withColumn("g", group)
        inner = F.element_at(_constant(coarse, "array<array<double>>"), F.greatest(F.col("g"), F.lit(1)))
        place = F.when(F.col("g") == 0, 0).otherwise(
            (F.col("g") - 1) * wide + F.aggregate(inner, F.lit(0), lambda a, x: a + F.when(x <= at, 1).otherwise(0))
        )
    else:
        rows, place = rows.withColumn("g", F.lit(0)), F.lit(0)
    # rows without an id come last, by a hash of their texts, so that many of them make several ranges
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("no_id")).first()
    lone = max(1, -(-total["no_id"] * n // max(total["n"], 1)))
    share = (F.lit(float(2**63)) - F.col("tie").cast("double")) / float(2**64)
    last = F.lit(lone - 1) - F.least(F.floor(share * lone), F.lit(lone - 1))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), last).otherwise(place + lone).cast("int")).drop("g")
    order = F.struct("doc_id", "tie")
    tops = {
        r["bucket"]: (r["top"]["doc_id"], r["top"]["tie"]) for r in rows.groupBy("bucket").agg(F.max(order).alias("top")).collect()
    }  # one row a range
    falling = sorted(tops, reverse=True)
    after = {b: falling[(i - 1) % len(falling)] for i, b in enumerate(falling)}  # the range whose end is closed by b's first row
    if not falling:
        return rows.select("bucket", F.lit(False).alias("halo"), "doc_id", "text", "tie")
    span = range(max(falling) + 1)
    told = [_constant([tops.get(b, (None, None))[i] for b in span], "array<bigint>") for i in (0, 1)]
    top_id, top_tie, goes = (F.element_at(x, F.col("bucket") + 1) for x in (*told, _constant([after.get(b, 0) for b in span], "array<int>")))
    first = F.col("doc_id").eqNullSafe(top_id) & F.col("tie").eqNullSafe(top_tie)
    own = F.struct("bucket", F.lit(False).alias("halo"))
    sent = F.when(first, F.array(own, F.struct(goes.alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    rows = rows.select(F.explode(sent).alias("to"), "doc_id", "text", "tie").select("to.*", "doc_id", "text", "tie")
    return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), F.desc("tie"))


def fingerprints_with_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and likenesses to the edited and the next text.

    Null text is empty; an empty text has no features, is like another empty one (1.0) and unlike all others (0.0);
    equal ids go by a hash of their texts; null ids come last; one row alone is its own next; no rows give none.
    """
    ranks = ranks_of(bin_counts(documents, text))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[tuple] = []  # (bucket, doc_id, text, halo): rows whose successors are still to come
        size = 0

        def finish(last: bool) -> pa.RecordBatch | None:
            nonlocal chain, size
            pairs = [(a, b) for a, b in zip(chain, chain[1:]) if a[0] == b[0] and not a[3]]
            fps = fingerprints_of([x[2] for x in chain], ranks)
            at = {id(x): fp for x, fp in zip(chain, fps, strict=True)}
            new = [edited(a[2].decode(), b[2].decode()).encode() for a, b in pairs]
            rows = []
            for (a, b), text, fp in zip(pairs, new, fingerprints_of(new, ranks), strict=True):
                own = at[id(a)]
                rows.append((a[1], len(a[2].decode()), hashlib.sha256(text).hexdigest(), text_form(own), text_form(fp), likeness(own, fp), likeness(own, at[id(b)])))
            chain, size = ([] if last else chain[-1:]), 0
            return _rows(rows, names) if rows else None

        closed = None
        for part, texts in slices(batches):
            for bucket, halo, doc_id, raw in zip(
                part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, strict=True
            ):
                if halo and bucket == closed:
                    continue  # a repeated first row closes its range once
                closed = bucket if halo else closed
                chain.append((bucket, doc_id, raw, halo))
                size += len(raw)
                if size > STEP_BYTES:
                    if (out := finish(False)) is not None:
                        yield out
        if chain and (out := finish(True)) is not None:
            yield out

    return in_order(documents, key, text).select("bucket", "halo", "doc_id", "text").mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
