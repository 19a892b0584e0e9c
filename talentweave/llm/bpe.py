"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each Spark partition.

Texts are cut by the usual pattern (letters, numbers, other signs, white space, a few contractions).  The different
pieces of a slice become rows (piece, offset, length, token), one a byte; a recursive query joins neighbouring
rows with the merge table and contracts, in every piece, the leftmost pair of least rank, until no piece has one.
The last rows in order give each piece's ids, and through the vocabulary its bytes again.

A round contracts every occurrence of a piece's least pair at once where that cannot change the outcome: if the
new token takes part only in merges of a higher rank, the other occurrences would come next anyway.  Otherwise it
contracts the leftmost alone.  With it go the pairs that are sure to be contracted whatever happens beside them: no
merge of their rank or a lower one takes their left token after a token that ends in the byte before, or their right
token before one that begins with the byte after, and their own new token has no merge of a lower rank.  Such pairs
never share a token.  Before that, pieces are cut between bytes that no token holds side by side.
"""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import itertools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from talentweave.llm.common import flat, only, slices, span_codes, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of text whose new pieces are learnt together, and of those cut into pieces at once.
SLICE, PART = 3 << 20, 3 << 18
#: Pieces remembered by a worker (some 70 bytes each) before it forgets, and at most after that.
KEPT, STAY = 300_000, 225_000

#: Pieces longer than this are contracted in place, so that a query holds one row a token however many rounds it takes.
LONG = 1000

#: Stands for the byte before a piece and the byte after it.
NONE = 256

_ROUND = """
   pair AS (
     SELECT a.piece, a.off, a.len, b.len AS more, m.t, m.alone, m.twin, a.before, b.after,
       get_bit(m.before, a.before) + get_bit(m.after, b.after) = 0 AS sure
     FROM {now} a JOIN {now} b ON b.off = a.off + a.len JOIN merges m ON m.l = a.tok AND m.r = b.tok),
   best AS (SELECT piece, min(t::BIGINT * 4294967296 + off) AS least FROM pair GROUP BY piece),
   hits AS (
     SELECT p.piece, p.off, p.len, p.more, p.t, p.before, p.after, p.twin AND NOT p.sure AS twin
     FROM pair p JOIN best b ON b.piece = p.piece
     WHERE p.sure OR b.least // 4294967296 = p.t AND (NOT p.alone OR p.off = b.least % 4294967296)),
   twins AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY off) AS n FROM hits WHERE twin),
   chosen AS (
     SELECT piece, off, len, more, t, before, after FROM hits WHERE NOT twin
     UNION ALL
     SELECT piece, off, len, more, t, before, after
     FROM (SELECT *, row_number() OVER (PARTITION BY piece, off - n * len ORDER BY off) AS k FROM twins) WHERE k % 2 = 1)"""

_RESULT = """
SELECT s.piece, s.tok, v.bytes
FROM s {last} JOIN vocabulary v ON v.tok = s.tok
ORDER BY s.off"""

_RECURSIVE = f"""
WITH RECURSIVE s AS (
  SELECT 0 AS it, piece, off, len, tok, before, after FROM symbols
  UNION ALL
  (WITH {_ROUND.format(now="s")}
   SELECT s.it + 1, s.piece, s.off, s.len + coalesce(c.more, 0), coalesce(c.t, s.tok), s.before, coalesce(c.after, s.after)
   FROM s SEMI JOIN best b ON b.piece = s.piece LEFT JOIN chosen c ON c.off = s.off ANTI JOIN chosen d ON d.off + d.len = s.off)
), last AS (SELECT piece, max(it) AS it FROM s GROUP BY piece)
{_RESULT.format(last="JOIN last l ON l.piece = s.piece AND l.it = s.it")}"""

_IN_PLACE = f"""
WITH RECURSIVE s(piece, off, len, tok, before, after) USING KEY (off) AS (
  SELECT piece, off, len, tok, before, after FROM symbols
  UNION
  (WITH now AS (
     SELECT r.piece, r.off, r.len, r.tok, r.before, r.after FROM recurring.s r SEMI JOIN s a ON a.piece = r.piece WHERE r.tok >= 0),
   {_ROUND.format(now="now")}
   SELECT piece, off, len + more, t, before, after FROM chosen
   UNION ALL
   SELECT piece, off + len, 0, -1, {NONE}, {NONE} FROM chosen)
)
{_RESULT.format(last="")}"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, t, alone, twin, before, after): every two tokens that make a third, whatever merge made it first.

    ``before`` has a bit set for every byte that, just before l, lets another merge of l come first, ``after`` for every
    byte just after r; both have all bits set if t takes part in a merge of a lower rank.
    """
    rows = []
    for token, t in ranks.items():
        for i in range(1, len(token)):
            l, r = ranks.get(token[:i]), ranks.get(token[i:])
            if l is not None and r is not None:
                rows.append((l, r, t, token[i - 1], token[i]))
    l, r, t, last, first = (np.array(x, np.int32) for x in zip(*rows, strict=True))
    early = np.zeros(max(ranks.values()) + 1, bool)  # tokens that take part in a merge of a lower rank
    early[l[t < l]] = True
    early[r[t < r]] = True

    def rivals(tokens: np.ndarray, bytes_: np.ndarray, own: np.ndarray) -> pa.Array:
        least = np.full((len(early), NONE + 1), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(least, (tokens, bytes_), t)
        out = []
        for i in range(0, len(t), 10_000):
            some = t[i : i + 10_000, None]
            out += [x.tobytes() for x in np.packbits((least[own[i : i + 10_000]] <= some) | early[some], axis=1)]
        return pa.array(out, pa.binary())

    return pa.table({"l": l, "r": r, "t": t, "alone": early[t], "twin": l == r, "before": rivals(r, last, l), "after": rivals(l, first, r)})


class Encoder:
    """A DuckDB connection with the merge table and the vocabulary; one in a process."""

    def __init__(self, path: str):
        import duckdb

        ranks = read_ranks(path)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Neighbouring bytes that stand together in some token; no merge crosses any others.
        self.meet = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.meet[b[:-1], b[1:]] = True
        # what does not fit goes where Spark itself spills, and goes with the executor
        spill = os.path.join(SparkFiles.getRootDirectory(), f"duckdb-{os.getpid()}")
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "120MB", "temp_directory": spill})
        given = merge_rows(ranks)
        self.con.register("given", given)
        self.con.execute("CREATE TABLE merges AS SELECT * REPLACE (before::BIT AS before, after::BIT AS after) FROM given")
        self.con.unregister("given")
        given = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        self.con.register("given", given)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")

    def encode(self, pieces: list[bytes], most: int = 300_000) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """All pieces' ids, how many each has, all their decoded bytes, and how many each has.

        At most about ``most`` bytes of pieces go into one query; long pieces go into queries of their own kind.
        """
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        if long and len(long) < len(pieces):  # long ones after the others, and back in place
            order = np.array([i for i, p in enumerate(pieces) if len(p) <= LONG] + long)
            ids, counts, decoded, sizes = (
                x + y if isinstance(x, bytes) else np.concatenate([x, y]) for x,
                y in zip(self.encode([pieces[i] for i in order[: -len(long)]], most), self.encode([pieces[i] for i in long], most), strict=True)
            )
            back = np.argsort(order)
            begin, at = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
            ids = np.concatenate([ids[begin[i] : begin[i] + counts[i]] for i in back])
            return ids, counts[back], b"".join(decoded[at[i] : at[i] + sizes[i]] for i in back.tolist()), sizes[back]
        ids, counts, decoded, sizes, first = [], [], [], [], 0
        while first < len(pieces):
            last, size = first, 0
            while last < len(pieces) and (last == first or size + len(pieces[last]) <= most):
                size += len(pieces[last])
                last += 1
            some = pieces[first:last]
            lengths = np.fromiter(map(len, some), np.int32, len(some))
            piece = np.repeat(np.arange(len(some), dtype=np.int32), lengths)
            data = np.frombuffer(b"".join(some), np.uint8)
            off = np.arange(len(data), dtype=np.int32) + piece  # a gap of one between pieces keeps them apart
            before, after = np.append(NONE, data[:-1]).astype(np.int16), np.append(data[1:], NONE).astype(np.int16)
            edge = np.flatnonzero(np.diff(piece)) + 1
            before[edge], after[edge - 1] = NONE, NONE
            symbols = pa.table({"piece": piece, "off": off, "len": np.ones(len(data), np.int32), "tok": self.byte[data], "before": before, "after": after})
            self.con.register("symbols", symbols)
            got = self.con.sql(_IN_PLACE if long else _RECURSIVE).to_arrow_table()
            self.con.unregister("symbols")
            of = got.column("piece").to_numpy()
            ids.append(got.column("tok").to_numpy().astype(np.uint32))
            counts.append(np.bincount(of, minlength=len(some)))
            back = got.column("bytes").combine_chunks()
            at = np.frombuffer(back.buffers()[1], np.int32)[back.offset : back.offset + len(back) + 1]
            decoded.append(back.buffers()[2][at[0] : at[-1]].to_pybytes())
            sizes.append(np.bincount(of, np.diff(at), len(some)).astype(np.int64))
            first = last
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64), b"".join(decoded), np.concatenate(sizes)


_MADE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point, by Unicode properties; made once in a process."""
    if not _CLASSES:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{White_Space}+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                s, e = (x + (0x800 if x >= 0xD800 else 0) for x in m.span())
                table[s:e] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def cut(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in code points of texts that begin where ``begins`` is set.

    One space before a run of letters, numbers or other signs goes with it; white space before such a run otherwise
    gives its last character away; an apostrophe alone takes s, t, m, d, re, ve or ll from the letters after it.
    """
    n = len(points)
    kind = classes()[points]
    edge = begins.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    inner = (ends < n) & ~np.append(begins, True)[ends]  # another run of the same text follows
    out = edge.copy()
    spaces = inner & (kind[starts] == SPACE)
    last = ends[spaces] - 1
    out[last] = True
    out[ends[spaces][points[last] == 0x20]] = False
    lone = inner & (kind[starts] == OTHER) & (ends - starts == 1) & (points[starts] == 0x27)
    at = starts[lone]
    at = at[begins[at] | (points[at - 1] != 0x20)]
    at = at[kind[at + 1] == LETTER]
    one = points[at + 1]
    two = np.where((at + 2 < n), points[np.minimum(at + 2, n - 1)], 0)
    two = np.where(np.append(begins, True)[np.minimum(at + 2, n)], 0, two)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, size in ((short, 1), (long & ~short, 2)):
        a = at[hit]
        out[a + 1] = False
        a = a[a + 1 + size < n]
        out[a + 1 + size] = True
    return np.flatnonzero(out)


@dataclasses.dataclass
class Part:
    """Texts cut into pieces: their bytes, where each text starts (one more at the end) as a byte and as a piece, the
    number of every piece, and of the different ones the starts, ends and hashes."""

    data: np.ndarray
    bounds: np.ndarray
    at: np.ndarray
    code: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


class Pieces:
    """The pieces that a worker has met, with their ids and bytes, in flat arrays; kept from partition to partition."""

    def __init__(self, path: str):
        self.path, self.seed = path, 1
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where each is
        self.ids, self.begins = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bytes, self.at = b"", np.zeros(1, np.int64)
        self.slice = 0
        self.met, self.since = np.zeros(0, np.int32), np.zeros(0, np.int32)  # slices that had the piece, and the first of them

    def _forget(self) -> None:
        """Pieces met in one slice alone go; of the others those stay that come in most of the slices since they were first met."""
        stay = np.flatnonzero(self.met > 1)
        if len(stay) > STAY:
            rate = self.met[stay] / (self.slice - self.since[stay] + 1)
            stay = np.sort(stay[np.argpartition(-rate, STAY)[:STAY]])
        place = np.full(len(self.met), -1)
        place[stay] = np.arange(len(stay))
        own = place[self.places]
        self.keys, self.places = self.keys[own >= 0], own[own >= 0]
        counts, sizes = np.diff(self.begins)[stay], np.diff(self.at)[stay]
        self.ids = self.ids[flat(self.begins[stay], counts)]
        self.bytes = np.frombuffer(self.bytes, np.uint8)[flat(self.at[stay], sizes)].tobytes()
        self.begins, self.at = (np.append(0, np.cumsum(x)) for x in (counts, sizes))
        self.met, self.since = self.met[stay], self.since[stay]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)
        near = np.empty(len(hashes), np.int64)
        near[order] = np.minimum(np.searchsorted(self.keys, hashes[order]), len(self.keys) - 1)
        return np.where(self.keys[near] == hashes, self.places[near], -1)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids, counts, decoded, sizes = encoder(self.path).encode(pieces)
        places = len(self.begins) - 1 + np.arange(len(hashes))
        self.keys, self.places = np.concatenate([self.keys, hashes]), np.concatenate([self.places, places])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], self.places[order]
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(counts)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.ids, self.bytes = np.concatenate([self.ids, ids]), self.bytes + decoded
        self.met = np.concatenate([self.met, np.zeros(len(hashes), np.int32)])
        self.since = np.concatenate([self.since, np.full(len(hashes), self.slice, np.int32)])

    def _cut(self, texts: list[bytes]) -> Part:
        whole = b"".join(texts)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole, np.uint8)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each code point
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        begins = np.zeros(len(points) + 1, bool)
        begins[np.searchsorted(place, bounds[:-1])] = True
        edge = np.zeros(len(data), bool)
        if len(points):
            edge[place[cut(points, begins[:-1])]] = True
        # a piece is cut where no token can run on
        edge[1:] |= ~encoder(self.path).meet.ravel()[data[:-1].astype(np.int64) << 8 | data[1:]]
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(data, starts, ends, self.seed)
        code, first = span_codes(data, starts, ends, hashes)
        return Part(data, bounds, np.searchsorted(starts, bounds), code, starts[first], ends[first], hashes[first])

    def _known(self, parts: list[Part]) -> list[tuple[np.ndarray, bytes]] | None:
        """Learn what is new in the parts; the places of each part's pieces, and the bytes decoded from their ids.

        Decoded bytes must be the texts' own; where two pieces share a hash they are not, and there is nothing to give.
        """
        new: dict[int, bytes] = {}
        for part in parts:
            for i in np.flatnonzero(self._find(part.hashes) < 0).tolist():
                new.setdefault(int(part.hashes[i]), part.data[part.starts[i] : part.ends[i]].tobytes())
        if new:
            self._learn(np.fromiter(new, np.uint64, len(new)), list(new.values()))
        out, known = [], np.frombuffer(self.bytes, np.uint8)
        for part in parts:
            number = self._find(part.hashes)
            every = number[part.code]
            decoded = known[flat(self.at[every], self.at[every + 1] - self.at[every])]
            if not np.array_equal(decoded, part.data):
                return None
            self.met[number] += 1
            out.append((number, decoded.tobytes()))
        return out

    def encode(self, texts: list[bytes], each: Callable[[np.ndarray, bytes], None]) -> None:
        """Call ``each(ids, decoded bytes)`` for every text in order."""
        if len(self.keys) > KEPT:
            self._forget()
        self.slice += 1
        ends, parts, first = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PART, side="right")))
            parts.append(self._cut(texts[first:last]))
            first = last
        found = self._known(parts)
        for again in (1, 2, 3):
            if found is not None:
                break
            self._clear()
            self.seed += 1
            numbers: dict[bytes, int] = {}  # for texts made to share hashes whatever the seed: pieces by their order
            for part in parts:
                if again < 3:
                    part.hashes = span_hashes(part.data, part.starts, part.ends, self.seed)
                else:
                    pieces = (part.data[s:e].tobytes() for s, e in zip(part.starts.tolist(), part.ends.tolist(), strict=True))
                    part.hashes = np.fromiter((numbers.setdefault(x, len(numbers)) for x in pieces), np.uint64, len(part.starts))
            found = self._known(parts)
            if again == 3:
                self.keys, self.places = self.keys[:0], self.places[:0]
        for part, (number, decoded) in zip(parts, found, strict=True):
            begin, count = self.begins[number], self.begins[number + 1] - self.begins[number]
            count = count[part.code]
            ids = self.ids[flat(begin[part.code], count)]
            to = np.append(0, np.cumsum(count))[part.at].tolist()
            for i, (s, e) in enumerate(itertools.pairwise(part.bounds.tolist())):
                each(ids[to[i] : to[i + 1]], decoded[s:e])


_PIECES: dict[str, Pieces] = {}


def known_pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


def round_trip(documents: DataFrame, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Null texts are empty; an empty text has no tokens and the digests of no bytes; long texts are encoded whole, in
    pieces; repeated rows give equal rows; an empty table gives none.  The rank file is read where it lies on each
    worker.  Only the two named columns are read.
    """

    def run(batches):
        pieces = known_pieces(_path(ranks))
        for part, texts in slices(batches, most=SLICE):
            n, ids_sha, bytes_sha = [], [], []

            def each(ids: np.ndarray, decoded: bytes) -> None:
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                bytes_sha.append(hashlib.sha256(decoded).hexdigest())

            pieces.encode(texts, each)
            keys = part.column(0).take(pa.array(np.arange(part.num_rows)))  # a copy, which does not hold the batch's texts
            del part, texts
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return only(documents, key, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(documents: DataFrame, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every row and the text decoded from them."""

    def run(batches):
        pieces = known_pieces(_path(ranks))
        for part, texts in slices(batches, most=SLICE):
            ids_, decoded_ = [], []

            def each(ids: np.ndarray, decoded: bytes) -> None:
                ids_.append(ids.astype(np.int32))
                decoded_.append(decoded.decode())

            pieces.encode(texts, each)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids_, pa.list_(pa.int32())), pa.array(decoded_, pa.string())],
                ["doc_id", "ids", "decoded"]
            )

    return only(documents, key, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
