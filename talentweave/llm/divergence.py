"""How far the words of each source are from those of the other sources, and of the whole, of its language.

Terms are counted once.  Which of a group's terms are furthest above their language is found by dominance: a term that
k others beat in group count, language count and place in the alphabet at once can't be among the first k, so every
partition keeps only its skyband, skybands are merged, and what is left is ranked exactly.  Sums over pairs of sources
use that a term neither of them has is worth the same everywhere: only terms that both have are looked at together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import concatenated, discard, give_back, map_slices, only, partitions, span_codes, written

SCALE = 1_000_000_000
#: A table of groups (lang, source) of at most so many rows is broadcast.
BROADCAST_GROUPS = 10_000
#: Pairs of sources held at once by a task, rows of a skyband compared at once, and bytes of text counted at once: terms
#: repeat, so larger slices send fewer rows.
PAIRS, BLOCK, SLICE = 1 << 20, 1024, 4 << 20

#: 1 for the bytes of terms: A-Z, a-z and all of other characters than ASCII; and A-Z lower-cased.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed over slices of texts in each task."""

    def count(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        data, bounds = concatenated(texts)
        data = _LOWER[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_TERM[data], [False]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        doc = np.searchsorted(bounds, starts, side="right") - 1
        term, first = span_codes(data, starts, ends)
        names = pd.MultiIndex.from_arrays([batch.column(0).to_pylist(), batch.column(1).to_pylist()])
        of_doc, groups = pd.factorize(names)
        key = doc.astype(np.int64) * max(1, len(first)) + term
        in_doc, n = np.unique(key, return_counts=True)  # one row a document and term
        doc, term = np.divmod(in_doc, max(1, len(first)))
        key, at = np.unique(of_doc[doc].astype(np.int64) * max(1, len(first)) + term, return_inverse=True)
        group, term = np.divmod(key, max(1, len(first)))
        raw = data.tobytes()
        langs, sources = (np.array([g[i] for g in groups], object) for i in (0, 1))
        return pa.RecordBatch.from_arrays([
            pa.array(langs[group], pa.string()), pa.array(sources[group], pa.string()),
            pa.array([raw[s:e].decode() for s, e in zip(starts[first[term]].tolist(), ends[first[term]].tolist(), strict=True)], pa.string()),
            pa.array(np.bincount(at, n, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)),
        ], names=["lang", "source", "term", "n", "docs"])

    sliced = map_slices(documents.select("lang", "source", "text"), count, "lang string, source string, term string, n long, docs long", most=SLICE)
    return sliced.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _ordered(band: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the alphabet of both, which are arrays of bytes."""
    both = np.concatenate([band, block])
    at = np.empty(len(both), np.int64)
    at[np.argsort(both, kind="stable")] = np.arange(len(both))
    return at[: len(band)], at[len(band) :]


class Skyband:
    """Rows that fewer than k others dominate, out of rows that come by count descending, then of all, then term.

    A row is dominated only by rows before it, and by k of all rows if by k of those kept; so rows that are let go
    need not be remembered.
    """

    def __init__(self, k: int) -> None:
        self.k, self.of_all, self.terms = k, np.empty(0, np.int64), np.empty(0, object)

    def keep(self, of_all: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Which rows of the next block stay."""
        stays = np.zeros(len(terms), bool)
        before, own = (x.astype(np.int32) for x in _ordered(self.terms, terms))
        by = np.count_nonzero((self.of_all[None, :] <= of_all[:, None]) & (before[None, :] < own[:, None]), axis=1)
        some = np.flatnonzero(by < self.k)
        if len(some):
            of_all, own = of_all[some], own[some]
            within = np.tril((of_all[None, :] <= of_all[:, None]) & (own[None, :] < own[:, None]), -1)
            some = some[by[some] + np.count_nonzero(within, axis=1) < self.k]
            stays[some] = True
        return stays

    def add(self, of_all: np.ndarray, terms: np.ndarray) -> None:
        self.of_all, self.terms = np.concatenate([self.of_all, of_all]), np.concatenate([self.terms, terms])


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of each group within each partition of (lang, source, term, n, of_all, p, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, Skyband(k)
        cell, held = None, 0  # the last cell of equal counts of a group, and how many of its rows came
        for whole in batches:
            if not whole.num_rows:
                continue
            names = pd.MultiIndex.from_arrays([whole.column(0).to_pylist(), whole.column(1).to_pylist()])
            of_group, groups = pd.factorize(names)
            cells = np.stack([of_group, whole.column(3).to_numpy(), whole.column(4).to_numpy()])
            begins = np.flatnonzero(np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(axis=0)]))
            sizes = np.diff(np.concatenate([begins, [whole.num_rows]]))
            place = np.arange(whole.num_rows) - np.repeat(begins, sizes)
            if cell == (*groups[0], cells[1, 0], cells[2, 0]):
                place[: sizes[0]] += held
            cell, held = (*groups[of_group[-1]], cells[1, -1], cells[2, -1]), int(place[-1]) + 1
            # of rows with equal counts the first k by term alone can stay
            first = np.flatnonzero(place < k)
            batch, of_group = whole.take(pa.array(first)), of_group[first]
            of_all = cells[2, first]
            terms = np.array(batch.column(2).cast(pa.binary()).to_pylist(), object)
            stays = np.zeros(len(first), bool)
            for number in pd.unique(of_group):
                begin, end = np.searchsorted(of_group, [number, number + 1])  # groups follow each other
                if groups[number] != group:
                    group, band = groups[number], Skyband(k)
                for at in range(begin, end, BLOCK):
                    part = slice(at, min(at + BLOCK, end))
                    stays[part] = now = band.keep(of_all[part], terms[part])
                    band.add(of_all[part][now], terms[part][now])
            yield batch.filter(pa.array(stays))

    rows = rows.sortWithinPartitions("lang", "source", F.desc("n"), "of_all", "term")
    return rows.mapInArrow(run, rows.schema)


def above(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_terms(terms: DataFrame) -> DataFrame:
    """(lang, a, b, value): over terms that both sources have, what their worth differs from that of each having it alone.

    ``terms``: lang and ``held``, an array of (no, p, p0) of the sources that have the term.  Pairs are summed in
    blocks of PAIRS, so memory doesn't depend on how many sources share a term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(lang: np.ndarray, names: np.ndarray, no: np.ndarray, size: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``size``: the number of sources of each row's term, whose rows follow each other."""
            first = np.concatenate([[0], np.cumsum(size)])
            for begin in _cuts(np.repeat(size, size), PAIRS):
                rows = np.arange(*begin)
                term = np.searchsorted(first, rows, side="right") - 1
                i = np.repeat(rows, size[term])
                ends = np.cumsum(size[term])
                j = np.arange(len(i)) - np.repeat(ends - size[term], size[term]) + np.repeat(first[term], size[term])
                value = above(p[i], p[j]) - above(p[i], p0[j]) - above(p0[i], p[j]) + above(p0[i], p0[j])
                wide = int(max(no[i].max(), no[j].max())) + 1
                key = (np.repeat(lang[term], size[term]) * wide + no[i]) * wide + no[j]
                if len(names) * wide * wide <= len(key):
                    out = np.zeros(len(names) * wide * wide, np.int64)
                    np.add.at(out, key, value)
                    key = np.flatnonzero(out)
                    out = out[key]
                else:
                    key, code = np.unique(key, return_inverse=True)
                    out = np.zeros(len(key), np.int64)
                    np.add.at(out, code, value)
                head, b = np.divmod(key, wide)
                of, a = np.divmod(head, wide)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[of], pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out)], names=["lang", "a", "b", "value"]
                )

        for batch in batches:
            held = batch.column(1)
            size = np.diff(held.offsets.to_numpy()).astype(np.int64)
            flat = held.flatten()
            lang, names = pd.factorize(np.array(batch.column(0).to_pylist(), object))
            no, p, p0 = (flat.field(x).to_numpy() for x in range(3))
            yield from block(lang, names, no, size, p, p0)
        give_back()

    out = terms.mapInArrow(run, "lang string, a long, b long, value long")
    return out.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _cuts(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose work is about ``most`` (one row at least)."""
    ends, begin = np.cumsum(work), 0
    while begin < len(work):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield begin, end
        begin = end


def audit(documents: DataFrame, first: int = 200, least: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance, and the terms furthest above the language.

    Every row is a document, rows that repeat as well; null lang, source and text are ''.  A term counts in a language
    if ``least`` of its documents have it.  Groups without such terms have their pairs, and languages without any have
    pairs of value 0.  Ties are ordered by UTF-8.  An empty table gives no rows; other columns are left behind.  All
    arithmetic is on integers; values fit 64 bits, since proportions add up to SCALE and the number of terms at most.

    Terms are shuffled as counts by group, summed on the map side.  Groups are met by a broadcast of at most
    BROADCAST_GROUPS rows, by merging beyond.  Skybands are merged by group and part first, then by group.
    """
    spark = documents.sparkSession
    docs = only(documents, "lang", "source", "text").toDF("lang", "source", "text").fillna("")
    counted = written(term_counts(docs), "terms")
    # a term's rows stand together, so one exchange serves its sum and what follows; the number of sources bounds them
    whole = counted.groupBy("lang", "term").agg(F.sum("n").alias("of_all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = written(counted.drop("docs").join(whole.hint("merge"), ["lang", "term"]), "kept")
    discard(counted)
    groups = docs.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sums.hint("merge"), ["lang", "source"], "left").fillna(0, ["total"])
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(langs.hint("merge"), "lang", "left").fillna(0, ["terms", "lang_total"])
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = written(groups.withColumns({"no": no, "p0": _p("0L", "total", "terms")}), "groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    near = F.broadcast if few else (lambda df: df.hint("merge"))
    rows = kept.join(near(groups), ["lang", "source"])
    rows = rows.withColumns({"p": _p("n", "total", "terms"), "q": _p("of_all", "lang_total", "terms")})
    rows = written(rows.select("lang", "source", "term", "n", "of_all", "p", "q", "no", "p0"), "proportions")
    discard(kept)

    found = skybands(rows.where("p > q").drop("no", "p0"), first)
    share = max(2, round(partitions(spark) ** 0.5))
    part = F.pmod(F.xxhash64("term"), F.lit(share))
    found = skybands(found.repartition(partitions(spark), "lang", "source", part), first)
    found = skybands(found.repartition(partitions(spark), "lang", "source"), first)
    terms = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    in_order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= first)

    held = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "p0")).alias("held"))  # one a source
    both = shared_terms(held.select("lang", "held"))
    alone = rows.groupBy("lang", "no", "p", "p0").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("no").alias("b"), F.col("p0").alias("p0_b"))
    worth = "(({0}) - ({1})) * (({0}) - ({1})) div ({1})"
    alone = alone.join(near(other), "lang")
    sides = [
        alone.groupBy("lang", F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(F.expr(f"m * ({f1} - {f0})")).alias("value"))
        for a, b, f1, f0 in (
            ("no", "b", worth.format("p", "p0_b"), worth.format("p0", "p0_b")), ("b", "no", worth.format("p0_b", "p"), worth.format("p0_b", "p0"))
        )
    ]
    mine = groups.select("lang", "source", F.col("no").alias("a"), F.col("p0").alias("p0_a"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("p0").alias("p0_b"))
    pairs = mine.join(near(other), "lang").where("a <> b")
    none = pairs.select("lang", "a", "b", F.expr(f"if(terms > 0, terms * ({worth.format('p0_a', 'p0_b')}), 0L)").alias("value"))
    total = none.unionByName(both).unionByName(sides[0]).unionByName(sides[1]).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", F.col("no").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    total = total.join(near(names[0]), ["lang", "a"]).join(near(names[1]), ["lang", "b"])
    pairs = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(in_order))
    return pairs.unionByName(terms)


def _p(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE (n + 1) / (total + terms)); null where a language has no terms."""
    return F.expr(f"cast(1 + (cast({SCALE} AS decimal(10, 0)) * cast({n} + 1 AS decimal(20, 0))) div nullif({total} + {terms}, 0) AS bigint)")
