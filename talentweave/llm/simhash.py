"""Near-duplicate groups by SimHash: fingerprints, tiled exact comparison, components.

Fingerprints: lower-case A-Z, words without ASCII white space, shingles of several words, XXH64 (seed 42) of
each, bit by bit majority.  Links: all pairs of different fingerprints within ``radius`` bits are found exactly,
tile against tile, by exclusive-or and bit counts.  A tile holds fingerprints of one population count, and tiles
whose counts differ beyond the radius never meet; inside a pair of tiles the same rule, on the counts of the four
16-bit words, skips small blocks.  A pair of tiles sends on a spanning forest of its links, not the links, so a
large group of near copies stays linear.

The pipeline's groups (``similar``) are made of exact Jaccard similarities; there fingerprints only propose pairs, and
only those are made and compared whose texts share a band of least hashes with another's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import discard, give_back, map_slices, mixed, only, partitions, rows_by_text, written
from talentweave.llm.components import components, local_forest
from talentweave.llm.prefixes import candidates

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Further 64-bit words of a wide fingerprint come from the same shingle hashes, scrambled with these.
_MORE = (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD)
#: Sets of the similarity asked for share no band in one of so many cases at most.
MISSED = 30_000
#: What travels with a wide fingerprint besides fp: its further words, its set's size and the group known so far.
_WIDE = ("w1", "w2", "w3", "n", "label")


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """Hashes of all shingles of a text in order, repeated ones too; a text of fewer words is one shingle."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        return [digest(joined, 42)]
    cut = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts, ends = [0, *cut[: n - 1].tolist()], (cut[words - 1 :] - 1).tolist()
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, in order of size."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def fingerprint_slice(texts: list[bytes], words: int) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers; texts without words get zero."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = shingle_hashes(text, words)
        hashes += found
        counts[i] = len(found)
    return _majorities(np.array(hashes, np.uint64), counts)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each shingle set as four unsigned 64-bit numbers; empty sets get zeros."""
    h, counts = np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)
    return np.stack([_majorities(h, counts), *[_majorities(mixed(h ^ np.uint64(m)), counts) for m in _MORE]], axis=1)


def bands_for(similarity: float) -> tuple[int, int]:
    """Least hashes to a band, and bands, for sets of the similarity: 4 and 20 for 0.8."""
    rows = 1
    while rows < 16 and similarity ** (rows + 1) >= 0.4:
        rows += 1
    share = similarity**rows
    return rows, 1 if share >= 1 else int(np.ceil(np.log(MISSED) / -np.log1p(-share)))


def band_keys(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """(sets, bands) of numbers: two sets have one in common where ``rows`` least hashes are the same in both; none is empty."""
    h, counts = np.concatenate(sets), np.array([len(x) for x in sets], np.int64)
    starts, out = np.cumsum(counts) - counts, np.empty((len(sets), bands), np.uint64)
    factors = mixed(np.arange(1, rows * bands + 1, dtype=np.uint64)) | np.uint64(1)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            key = mixed(key ^ np.minimum.reduceat(h * factor, starts))
        out[:, band] = key
    return out


def _majorities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the number whose bits are those set in over half of them."""
    out, first = np.zeros(len(counts), np.uint64), 0
    for i, n in enumerate(counts.tolist()):
        ones = np.zeros(64, np.int64)
        for k in range(first, first + n, 1 << 16):
            bits = np.unpackbits(h[k : min(k + (1 << 16), first + n)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0] if n else 0
        first += n
    return out


def fingerprints(documents: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; null text counts as empty, whose fingerprint is zero."""

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        fp = fingerprint_slice(texts, words).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_slices(only(documents, key, text).toDF("doc_id", "text"), run, "doc_id long, fp long")


def _blocks(x: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Order of x by the bit counts of its four 16-bit words, cuts into blocks, and each block's least and largest counts."""
    counts = np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T)
    counts = counts[order]
    cuts = [(i, min(i + size, len(x))) for i in range(0, len(x), size)]
    return order, cuts, np.array([counts[i:j].min(0) for i, j in cuts]), np.array([counts[i:j].max(0) for i, j in cuts])


@dataclass
class Tile:
    """Fingerprints (n,), their nodes, and for wide ones all their words (n, 4), set sizes and groups known."""

    fp: np.ndarray
    node: np.ndarray
    words: np.ndarray | None = None
    size: np.ndarray | None = None
    group: np.ndarray | None = None

    def ordered(self, order: np.ndarray) -> Tile:
        return Tile(*[None if x is None else x[order] for x in (self.fp, self.node, self.words, self.size, self.group)])


def _near(a: Tile, b: Tile, radius: int, same: bool, size: int) -> Iterator[tuple[Tile, Tile, np.ndarray, np.ndarray]]:
    """Block by block all pairs whose first words lie within the radius, each once: both tiles and places in them."""
    order, cuts_a, low_a, high_a = _blocks(a.fp, size)
    a = a.ordered(order)
    if same:
        b, cuts_b, low_b, high_b = a, cuts_a, low_a, high_a
    else:
        order, cuts_b, low_b, high_b = _blocks(b.fp, size)
        b = b.ordered(order)
    for i, (s, e) in enumerate(cuts_a):
        apart = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(1)
        for j in np.flatnonzero(apart <= radius).tolist():
            if same and j < i:
                continue
            t, u = cuts_b[j]
            near = np.bitwise_count(a.fp[s:e, None] ^ b.fp[None, t:u]) <= radius
            if near.any():
                p, q = np.nonzero(near)
                if same and i == j:
                    p, q = p[p < q], q[p < q]
                yield a, b, p + s, q + t


def tile_links(a: Tile, b: Tile, radius: int, same: bool, size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within the radius between two tiles of different fingerprints."""
    found_a, found_b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for x, y, p, q in _near(a, b, radius, same, size):
        p, q = x.node[p], y.node[q]
        keep = p != q
        found_a.append(p[keep])
        found_b.append(q[keep])
        held += int(keep.sum())
        if held > 1 << 17:  # thin out as we go
            p, q = local_forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [p], [q], len(p)
    return local_forest(np.concatenate(found_a), np.concatenate(found_b))


def nearest_forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a spanning forest of the least distances."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(far, kind="stable")
    left, right = at[: len(a)][order], at[len(a) :][order]
    label, live, kept = np.arange(len(nodes)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        p, q = label[left[live]], label[right[live]]
        live, p, q = live[p != q], p[p != q], q[p != q]
        if not len(live):
            return order[np.concatenate(kept)]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, p, live)
        np.minimum.at(best, q, live)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        moved, least = local_forest(label[left[chosen]], label[right[chosen]])
        to = np.arange(len(nodes))
        to[moved] = least
        label = to[label]


def tile_proposals(
    a: Tile, b: Tile, radius: int, same: bool, wide_radius: int, similarity: float, thin: bool, size: int = 512
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, nodes, set sizes, set sizes) of pairs that may have the similarity: within both radii, sizes that allow it.

    Pairs of one known group are left out.  With ``thin`` a spanning forest of the nearest pairs, else all of them.
    """
    held, count = [], 0
    for x, y, p, q in _near(a, b, radius, same, size):
        far = np.bitwise_count(x.words[p] ^ y.words[q]).sum(1, dtype=np.int64)
        few, many = np.minimum(x.size[p], y.size[q]), np.maximum(x.size[p], y.size[q])
        keep = (far <= wide_radius) & (x.group[p] != y.group[q]) & (many > 0)
        keep[keep] = few[keep] / many[keep] >= similarity
        if not keep.any():
            continue
        p, q, far = p[keep], q[keep], far[keep]
        pairs = (x.node[p], y.node[q], x.size[p], y.size[q], far)
        if not thin:
            yield pairs[:4]
            continue
        held.append(pairs)
        count += len(p)
        if count > 1 << 19:
            held = [_thinned(held)]
            count = len(held[0][0])
    if held:
        yield _thinned(held)[:4]


def _thinned(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    pairs = [np.concatenate(x) for x in zip(*held, strict=True)]
    kept = nearest_forest(pairs[0], pairs[1], pairs[4])
    return tuple(x[kept] for x in pairs)


def _fitting(p: np.ndarray, q: np.ndarray, n_p: np.ndarray, n_q: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs cut so that their different nodes have at most so many shingles: nodes, and the pairs as places in them."""
    nodes, first, at = np.unique(np.concatenate([p, q]), return_index=True, return_inverse=True)
    if len(p) == 1 or np.concatenate([n_p, n_q])[first].sum() <= most:
        yield nodes, at[: len(p)], at[len(p) :]
        return
    half = len(p) // 2
    for part in (slice(None, half), slice(half, None)):
        yield from _fitting(p[part], q[part], n_p[part], n_q[part], most)


def _tile_pairs(
    distinct: DataFrame, radius: int, tile: int, compare: Callable[[int, int, dict[int, Tile]], Iterator[pa.RecordBatch]],
    schema: str
) -> DataFrame:
    """``compare`` of every two tiles that can hold pairs within the radius.

    ``distinct`` has columns node and fp, for wide fingerprints also w1, w2, w3, n and label.  The driver collects
    only how many fingerprints have each of the 65 population counts; from that every tile's partners follow.  A
    tile holds a few neighbouring counts where the radius is wide.
    """
    spark = distinct.sparkSession
    more = [c for c in _WIDE if c in distinct.columns]
    band = max(1, radius // 4)
    tiles = distinct.select("node", "fp", *more, F.floor(F.bit_count("fp") / band).cast("int").alias("pc"))
    chunks = {r["pc"]: -(-r["n"] // tile) for r in tiles.groupBy("pc").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    first, start = {}, 0
    for pc in sorted(chunks):
        first[pc], start = start, start + chunks[pc]
    if not chunks:
        return spark.createDataFrame([], schema)
    reach = -(-radius // band)

    def number(values: dict[int, int]) -> F.Column:
        return F.element_at(F.array(*[F.lit(values.get(pc, 0)) for pc in range(65)]), F.col("pc") + 1)

    own = number(first) + F.pmod(F.xxhash64("node", F.lit("tile")), number(chunks)).cast("int")
    ends = {pc: max(first[p] + chunks[p] for p in range(pc, pc + reach + 1) if p in chunks) for pc in chunks}
    starts = {pc: min(first[p] for p in range(pc - reach, pc + 1) if p in chunks) for pc in chunks}
    # a tile travels as one packed row to each pair of tiles it belongs to, so a fingerprint costs a few bytes a partner
    packed = tiles.select(
        "node", F.array("fp", *more).alias("fps"), own.alias("t"), number(starts).alias("from"), number(ends).alias("to")
    ).groupBy("t").applyInArrow(_pack, "t int, `from` int, `to` int, nodes binary, fps binary")
    sent = packed.select("t", "nodes", "fps", F.explode(F.expr("sequence(`from`, `to` - 1)")).alias("u"))
    sent = sent.select(F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), "t", "nodes", "fps")
    width = 1 + len(more)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for t, nodes, fps in zip(batch.column("t"), batch.column("nodes"), batch.column("fps"), strict=True):
                words = np.frombuffer(fps.as_buffer(), np.uint64).reshape(-1, width)
                rest = (words[:, :4], words[:, 4].astype(np.int64), words[:, 5]) if width > 1 else ()
                held[t.as_py()] = Tile(np.ascontiguousarray(words[:, 0]), np.frombuffer(nodes.as_buffer(), np.int64), *rest)
        lo, hi = key[0].as_py(), key[1].as_py()
        if lo in held and hi in held:
            yield from compare(lo, hi, held)
        give_back()

    return sent.groupBy("lo", "hi").applyInArrow(run, schema)


def links(distinct: DataFrame, radius: int = 4, tile: int = 65536) -> DataFrame:
    """(a, b long): links between different fingerprints whose components are those of all pairs within the radius.

    ``distinct`` has columns node and fp, without repeats.
    """

    def compare(lo: int, hi: int, held: dict[int, Tile]) -> Iterator[pa.RecordBatch]:
        p, q = tile_links(held[lo], held[hi], radius, lo == hi)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return _tile_pairs(distinct, radius, tile, compare, "a long, b long")


#: Pairs to confirm, in blocks: places in the block's nodes, as packed 32-bit numbers.
_BLOCK = "lo int, hi int, seq int, nodes array<long>, a binary, b binary"


def _packed(lo: int, hi: int, pairs: tuple[np.ndarray, ...], most: int, seq: int = 0) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set sizes of a, set sizes of b) as blocks, numbered from ``seq`` on."""
    order = np.lexsort((pairs[1], pairs[0]))
    for nodes, a, b in _fitting(*[x[order] for x in pairs], most):
        ids = [pa.array([x], pa.int32()) for x in (lo, hi, seq)]
        yield pa.RecordBatch.from_arrays(
            [*ids, pa.array([nodes], pa.list_(pa.int64())), *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (a, b)]],
            ["lo", "hi", "seq", "nodes", "a", "b"]
        )
        seq += 1


def proposals(distinct: DataFrame, similarity: float, tile: int = 131072, most: int = 1 << 21) -> DataFrame:
    """(lo, hi, seq, nodes, a, b): a spanning forest of the nearest pairs that may have the similarity, in blocks.

    A block's nodes have at most ``most`` shingles (or it is one pair), so that one task can hold their sets.
    """
    radius, wide = wide_radius(similarity, 64), wide_radius(similarity, 256)

    def compare(lo: int, hi: int, held: dict[int, Tile]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for pairs in tile_proposals(held[lo], held[hi], radius, lo == hi, wide, similarity, True):
            for block in _packed(lo, hi, pairs, most, seq):
                yield block
                seq += 1

    return _tile_pairs(distinct, radius, tile, compare, _BLOCK)


def partnered(distinct: DataFrame, similarity: float, tile: int = 131072) -> DataFrame:
    """(node): fingerprints for which another group has one that may have the similarity.

    A pair of tiles sends no more rows than the tiles have, whatever the number of pairs.
    """
    radius, wide = wide_radius(similarity, 64), wide_radius(similarity, 256)

    def compare(lo: int, hi: int, held: dict[int, Tile]) -> Iterator[pa.RecordBatch]:
        seen, new, count = np.zeros(0, np.int64), [], 0
        for p, q, _, _ in tile_proposals(held[lo], held[hi], radius, lo == hi, wide, similarity, False):
            new += [np.unique(p), np.unique(q)]
            count += len(new[-1]) + len(new[-2])
            if count > 1 << 20:
                seen, new, count = np.unique(np.concatenate([seen, *new])), [], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([seen, *new])))], ["node"])

    return _tile_pairs(distinct, radius, tile, compare, "node long").distinct()


def in_blocks(pairs: DataFrame, size: int = 1 << 16, most: int = 1 << 21) -> DataFrame:
    """Pairs (a, b, n_a, n_b) as blocks for ``confirmed``; those of one a go to at most 16 of them.  ``pairs`` is a table."""
    parts = max(partitions(pairs.sparkSession), -(-pairs.count() // size))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        yield from _packed(key[0].as_py(), 0, tuple(table.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b")), most)

    place = F.pmod(F.xxhash64("a", F.pmod("b", F.lit(16))), F.lit(parts)).cast("int")  # a's pairs mostly meet its set once
    dealt = pairs.select(place.alias("lo"), "a", "b", "n_a", "n_b")
    return dealt.groupBy("lo").applyInArrow(run, _BLOCK)


def jaccard_at_least(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """For each pair of places in ``sets`` whether the sets' Jaccard similarity is at least the given one; a is sorted."""
    sizes = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    parts = [code[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark, both = np.zeros(len(code) + 1, bool), np.zeros(len(a), np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])).tolist()
    for s, e in zip(cuts, cuts[1:], strict=False):
        mark[parts[a[s]]] = True
        for k in range(s, e):
            both[k] = np.count_nonzero(mark[parts[b[k]]])
        mark[parts[a[s]]] = False
    return both / (sizes[a] + sizes[b] - both) >= similarity


def confirmed(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b long): those pairs of the blocks whose shingle sets have the similarity."""
    keys = ["lo", "hi", "seq"]
    asked = blocks.select(F.explode("nodes").alias("node"), *[F.col(c).alias(f"of_{c}") for c in keys]).hint("merge").join(sets.hint("merge"), "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right.column("node").to_pylist(), right.column("shingles"), strict=True))
        out = [(np.zeros(0, np.int64),) * 2]
        for nodes, a, b in zip(*[left.column(c) for c in ("nodes", "a", "b")], strict=True):
            nodes = nodes.values.to_numpy()
            a, b = (np.frombuffer(x.as_buffer(), np.int32) for x in (a, b))
            yes = jaccard_at_least([np.frombuffer(held[x].as_buffer(), np.uint64) for x in nodes.tolist()], a, b, similarity)
            out.append((nodes[a[yes]], nodes[b[yes]]))
        give_back()
        return pa.table({c: np.concatenate(x) for c, x in zip("ab", zip(*out, strict=True), strict=True)})

    return blocks.groupBy(*keys).cogroup(asked.groupBy(*[f"of_{c}" for c in keys])).applyInArrow(run, "a long, b long")


def _pack(table: pa.Table) -> pa.Table:
    """All fingerprints of one tile as one row."""
    fps = table.column("fps").combine_chunks().flatten().to_numpy().tobytes()
    nodes = table.column("node").to_numpy().tobytes()
    return pa.table(
        {
            "t": table.column("t")[:1], "from": table.column("from")[:1], "to": table.column("to")[:1],
            "nodes": pa.array([nodes], pa.binary()), "fps": pa.array([fps], pa.binary())
        }
    )


def near_duplicates(documents: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: component_id is the smallest doc_id reachable by links.

    Null and blank texts have fingerprint zero and link like any other; repeated rows and ties share a component;
    a row whose doc_id is null is returned with its fingerprint and counts for no component's id (null if the
    component has no other); an empty table gives an empty result.  Only the two named columns are read.
    """
    fps = written(fingerprints(documents, words, key, text), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    of = components(links(classes.select(F.col("fp").alias("node"), "fp"), radius))
    joined = classes.hint("merge").join(of, classes["fp"] == of["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    joined = written(joined, "class-components")
    # both sides of the two joins come from tables, so adaptive execution can split a very large group
    least = written(joined.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    ids = written(joined.hint("merge").join(least, "component").select("fp", "component_id"), "ids")
    discard(classes, joined, least)
    return fps.hint("merge").join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_radius(similarity: float, bits: int, slack: float = 2.5) -> int:
    """Bits in which fingerprints of texts of a Jaccard similarity differ, and ``slack`` standard deviations more.

    Sets of one size and Jaccard similarity J have the cosine 2J / (1 + J); each bit differs with the probability of
    their angle over pi.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + slack * np.sqrt(bits * p * (1 - p))))


def sharing(classes: DataFrame) -> DataFrame:
    """(node): the classes (node, bands) that share a band with another.

    Bands are counted on the map side, and both sides of the join come from tables, so that adaptive execution splits
    a band of very many sets; no pairs are made.
    """
    bands = written(classes.select("node", F.explode("bands").alias("band")), "bands")
    shared = written(bands.groupBy("band").agg(F.count("*").alias("sets")).where("sets > 1").select("band"), "shared")
    out = written(bands.hint("merge").join(shared.hint("merge"), "band", "left_semi").select("node").distinct(), "sharing")
    discard(bands, shared)
    return out


def _wide(sets: DataFrame) -> DataFrame:
    """(node, fp, w1, w2, w3, n) of sets (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            fps = wide_fingerprints(held).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(fps[:, i]) for i in range(4)], pa.array([len(x) for x in held], pa.int64())], ["node", "fp", "w1", "w2", "w3", "n"]
            )
        give_back()

    return sets.select("node", "shingles").mapInArrow(run, "node long, fp long, w1 long, w2 long, w3 long, n long")


def _similar_classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, node) of ``docs`` (doc_id, text), and classes (node, best, component) of one shingle set.

    ``best`` is the class's first row: by doc_id, nulls last, then by the 128 bits of its key and text.
    """
    least, many = bands_for(similarity)

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = [shingle_set(x, words) for x in texts]
        sizes = np.array([len(x) for x in sets], np.int64)
        full = [x for x in sets if len(x)]
        keys = band_keys(full, least, many).view(np.int64).ravel() if full else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.where(sizes > 0, many, 0))).astype(np.int32), keys)
        return pa.RecordBatch.from_arrays([*part.columns[:3], _node_ids(sets), bands], ["doc_id", "k1", "k2", "node", "bands"])

    keyed = rows_by_text(docs).select("doc_id", "k1", "k2", "text")
    rows = written(map_slices(keyed, run, "doc_id long, k1 long, k2 long, node long, bands array<long>"), "shingled")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("best")
    classes = written(rows.groupBy("node").agg(best, F.first("bands").alias("bands")), "classes")
    nodes = sharing(classes)
    sets = _sets(docs, nodes, classes, words)
    wide = written(_wide(sets), "fingerprints")
    blocks = written(proposals(wide.withColumn("label", F.col("node")), similarity), "nearest-pairs")
    near = written(confirmed(blocks, sets, similarity), "confirmed")
    grouped = written(wide.hint("merge").join(components(near), "node", "left").select(*wide.columns, F.coalesce("component", "node").alias("label")), "grouped")
    discard(nodes, wide, blocks)
    nodes = written(partnered(grouped, similarity), "partnered")
    some = written(sets.hint("merge").join(nodes.hint("merge"), "node", "left_semi"), "partnered-sets")
    pairs = candidates(some, grouped, similarity)
    more = written(in_blocks(pairs), "pairs")
    also = written(confirmed(more, some, similarity), "confirmed")
    of = components(near.unionByName(also))
    joined = written(
        classes.hint("merge").join(of, "node", "left").select("node", "best", F.coalesce("component", "node").alias("component")),
        "class-components"
    )
    discard(classes, sets, near, grouped, nodes, some, pairs, more, also)
    return rows.select("doc_id", "k1", "k2", "node"), joined


def similar(documents: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a Jaccard similarity of their shingle sets of at least the given one.

    Texts of one shingle set are one class.  Sets at the given similarity share a band of least hashes but in 1 of
    30,000 cases, whatever their sizes; classes that share none with another are compared with nothing, so that the
    comparison of all tiles grows with the texts that have something like them.  Of the others,
    fingerprints of four 64-bit words, built from the sets, only propose pairs of classes: pairs of tiles compare the first words within a wide radius, and what is left in all 256 bits,
    so that pairs at the given similarity are proposed with a probability of over 0.98 (less for sets of a few
    shingles).  Every link is a pair whose sets were compared.  First a spanning forest of the nearest pairs is
    compared.  Of pairs between the groups found so (the others can't change the groups) only the texts are noted
    that stand in one; ``prefixes`` then finds among these all pairs that can have the similarity, by their rarest
    shingles, so that texts of one template which stay below it don't meet.  Null and blank texts are equal; null keys count for no component's id; an empty table gives no rows.
    """
    fps, joined = _similar_classes(only(documents, key, text).toDF("doc_id", "text"), words, similarity)
    least = written(joined.groupBy("component").agg(F.min("best.doc_id").alias("component_id")), "least")
    ids = written(joined.hint("merge").join(least, "component").select("node", "component_id"), "ids")
    discard(joined, least)
    return fps.hint("merge").join(ids, "node").select("doc_id", "component_id")


#: Texts of one key and text that stand in several rows are dealt to so many tasks.
SPREAD = 64


def one_of_each(documents: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``similar``, with all its columns: the row of the least key, null keys last.

    Rows are told apart by 128 bits of key and text, so rows without a key take part like any other.  Of rows that
    repeat (equal key and text) one stays: the least by its other columns.  An empty table gives no rows.
    """
    docs = only(documents, key, text).toDF("doc_id", "text")
    fps, joined = _similar_classes(docs, words, similarity)
    kept = joined.groupBy("component").agg(F.min("best").alias("b")).select("b.k1", "b.k2")
    times = fps.groupBy("k1", "k2").agg(F.count("*").alias("times"))
    kept = written(kept.hint("merge").join(times, ["k1", "k2"]), "kept")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    names = [f"c{i}" for i in range(len(columns))]
    rows = rows_by_text(
        documents.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), names[documents.columns.index(key)],
        names[documents.columns.index(text)]
    )
    back = [F.col(n).alias(c) for n, c in zip(names, documents.columns, strict=True)]
    out = rows.join(kept.where("times = 1").hint("shuffle_hash"), ["k1", "k2"], "left_semi").select(*back)
    if kept.where("times > 1").limit(1).count():
        # repeated rows: their few keys go to all of SPREAD places, so that no task gets all rows of one key
        several = kept.where("times > 1").select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("place"))
        met = rows.withColumn(
            "place", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
        ).join(several.hint("shuffle_hash"), ["k1", "k2", "place"], "left_semi")
        whole = F.struct(*names)
        for by in (["k1", "k2", "place"], ["k1", "k2"]):
            met = met.groupBy(*by).agg(F.min(whole).alias("row")).select(*by, "row.*")
        out = out.unionByName(met.select(*back))
    return out


def _node_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64))


def _sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the sets of the classes named, from the texts that represent them."""
    wanted = written(classes.select("node", "best.k1", "best.k2").hint("merge").join(nodes.hint("merge"), "node", "left_semi"), "wanted")

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = [shingle_set(x, words) for x in texts]
        return pa.RecordBatch.from_arrays([_node_ids(sets), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    asked = rows_by_text(docs).join(wanted.select("k1", "k2").hint("shuffle_hash"), ["k1", "k2"], "left_semi")
    return written(map_slices(asked.select("text"), run, "node long, shingles binary").dropDuplicates(["node"]), "sets")
