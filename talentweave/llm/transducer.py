"""Token counts by a finite-state transducer compiled from a piece vocabulary.

The vocabulary's merges (best score first, leftmost of equals) fix one segmentation of each text.  Two facts make
it a finite-state matter: a segmentation's beginning, up to any of its tokens, is the segmentation of that
beginning; and a sequence of tokens is a segmentation if each neighbouring two are one.  So after a character only
this has to be remembered: for each place where a token may still begin, how much of a token has been read since,
which token ended there, and how many tokens fewer (or more) there were.  That is a deterministic transducer over
characters whose transitions carry a number of tokens.  States are compiled when first met and kept.

Tokens never run on from another character into a word mark, so each word starts in the same state: the map from
states to states that a word stands for is constant, and the counts of words add up.  Words run in lockstep, one
character of every word a step.  Very long words are cut into chunks.  A chunk's map gives, for each state in which
it may be entered, the state in which it is left and the tokens counted; the states are those that the characters
before the chunk suggest and all in which the chunk before is left, so every map leads into the domain of the next.
The maps are composed by a parallel prefix scan: in each step every map is joined with the one that follows it, and
reaches twice as far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talentweave.llm.common import map_slices, only

MARK = 0x2581
#: Words longer than this are cut into chunks of this length.
CHUNK = 512
#: Characters before a chunk that suggest in which state it is entered.
LEAD = 48
#: The table of transitions is cut down to the states in use beyond so many cells (4 bytes each, and 1 for the count).
CELLS = 16_000_000
#: Beyond so many known pairs of tokens they are forgotten.
PAIRS = 500_000
#: Columns of the characters that no piece has: by the length of their UTF-8.
FOREIGN = 4


class Transducer:
    """Compiled from {piece: score}; characters outside all pieces count as their UTF-8 bytes (byte fallback),
    and those of one length are one character to it."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        names = list(scores)
        known = set(names)
        single = sorted({c for p in names for c in p} - known)
        self.names = names + single  # characters that are only parts of pieces stand for their bytes
        self.cost = [1] * len(names) + [len(c.encode()) for c in single]
        self.next: dict[tuple[int, str], int] = {}
        self.token = [-1]
        self.open = [False]
        for t, name in enumerate(self.names):
            node = 0
            for c in name:
                self.open[node] = True
                child = self.next.get((node, c))
                if child is None:
                    child = self.next[node, c] = len(self.token)
                    self.token.append(-1)
                    self.open.append(False)
                node = child
            self.token[node] = t
        self.other = len(self.names)  # a character that no piece has
        self.pairs: dict[int, bool] = {}
        self.classes = np.repeat(np.arange(FOREIGN, dtype=np.int32), [0x80, 0x800 - 0x80, 0x10000 - 0x800, 0x110000 - 0x10000])
        own = {c for p in self.names for c in p}
        self.classes[[ord(c) for c in own]] = -1  # columns of their own when met
        ranges = ((0, 0x80), (0x80, 0x800), (0xE000, 0x10000), (0x10000, 0x110000))
        # one that stands for all foreign ones of its length; if there is none, none can be met
        self.characters = [next((c for c in map(chr, range(*r)) if c not in own), "\0") for r in ranges]
        self.held: list[np.ndarray] = []
        self._begin()

    def _begin(self) -> None:
        """An empty table with the start state 0."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.go = np.full((1024, max(64, len(self.characters))), -1, np.int32)
        self.emit = np.zeros(self.go.shape, np.int8)

    def _cut_down(self, live: list[np.ndarray]) -> None:
        """A table of the live states alone (and the start state); their numbers are put in place of the old ones."""
        old = self.states
        kept = np.unique(np.concatenate([[0], *live]))
        self.states = [old[i] for i in kept.tolist()]
        self.number = {state: i for i, state in enumerate(self.states)}
        rows = max(1024, 2 * len(kept))
        self.go = np.full((rows, self.go.shape[1]), -1, np.int32)
        self.emit = np.zeros(self.go.shape, np.int8)
        for x in live:
            x[:] = np.searchsorted(kept, x)

    def segment(self, text: str) -> list[str]:
        """The segmentation itself, by merging; used on two tokens at a time."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, u: int, t: int) -> bool:
        """Whether tokens u, t are the segmentation of their text."""
        if u < 0 or u == self.other or t == self.other:
            return True
        key = u << 20 | t
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.names[u], self.names[t]
            known = self.pairs[key] = self.segment(a + b) == [a, b]
        return known

    def _step(self, state: tuple, c: str) -> tuple[tuple, int]:
        kept, found, more = [], None, 0
        for node, last, fewer in state:
            child = self.next.get((node, c))
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and found is None and self.follows(last, t):
                found, more = t, fewer + self.cost[t]
            if self.open[child]:
                kept.append((child, last, fewer))
        if found is None:  # no piece has the character
            found, more = self.other, len(c.encode())
        return (*[(n, last, fewer - more) for n, last, fewer in kept], (0, found, 0)), more

    def _expand(self, s: int, k: int) -> None:
        state, more = self._step(self.states[s], self.characters[k])
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.go):
                rows = len(self.go) // 2 + 1024
                self.go = np.concatenate([self.go, np.full((rows, self.go.shape[1]), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros((rows, self.emit.shape[1]), np.int8)])
        self.go[s, k] = n
        self.emit[s, k] = more

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Column of each code point in the table."""
        out = self.classes[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                self.classes[p] = len(self.characters)
                self.characters.append(chr(p))
            wide = len(self.characters) - self.go.shape[1]
            if wide > 0:
                wide = max(wide, 64)
                self.go = np.concatenate([self.go, np.full((len(self.go), wide), -1, np.int32)], axis=1)
                self.emit = np.concatenate([self.emit, np.zeros((len(self.emit), wide), np.int8)], axis=1)
            out = self.classes[points]
        return out

    def run(self, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts) of spans of columns, in lockstep, from state 0 or the given states."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order], lengths[order]
        state = np.zeros(len(at), np.int64) if entry is None else entry[order].astype(np.int64)
        count = np.zeros(len(at), np.int64)
        room = CELLS
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        for t, n in enumerate(alive.tolist()):
            k = columns[at[:n] + t]
            if len(self.states) * self.go.shape[1] > room:
                self._cut_down([state, *self.held])
                room = max(CELLS, 2 * len(self.states) * self.go.shape[1])
            s = state[:n]
            cell = s * self.go.shape[1] + k
            new = self.go.ravel()[cell]
            if (new < 0).any():
                for x in np.unique(cell[new < 0]).tolist():
                    self._expand(*divmod(x, self.go.shape[1]))
                new = self.go.ravel()[cell]
            count[:n] += self.emit.ravel()[cell]
            state[:n] = new
        out_s, out_c = np.empty_like(state), np.empty_like(count)
        out_s[order], out_c[order] = state, count
        return out_s, out_c

    def long_words(self, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of long words: maps of all their chunks, composed by a prefix scan."""
        many = -(-(ends - starts) // CHUNK)
        word = np.repeat(np.arange(len(starts)), many)
        first = np.cumsum(many) - many
        begin = starts[word] + (np.arange(len(word)) - first[word]) * CHUNK
        end = np.minimum(begin + CHUNK, ends[word])
        last = np.append(word[1:] != word[:-1], True)
        entry, _ = self.run(columns, np.maximum(begin - LEAD, starts[word]), begin)
        entry[first] = 0
        # a map's rows: chunk, state in which it is entered, state in which it is left, tokens
        chunk, count = np.arange(len(word)), np.zeros(0, np.int64)
        chunks, rows = np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        while len(chunk):
            # arrays of states are handed over, since a table that is cut down numbers its states anew
            self.held = [*rows, entry]
            left, tokens = self.run(columns, begin[chunk], end[chunk], entry)
            *rows, entry = self.held
            rows = (np.concatenate([rows[0], entry]), np.concatenate([rows[1], left]))
            chunks, count = np.concatenate([chunks, chunk]), np.concatenate([count, tokens])
            on = np.flatnonzero(~last[chunk])
            wide = len(self.states) + 1
            asked = np.unique((chunk[on] + 1) * wide + left[on])
            asked = asked[~np.isin(asked, chunks * wide + rows[0])]
            chunk, entry = asked // wide, asked % wide
        self.held = []
        wide = len(self.states) + 1
        names = chunks * wide + rows[0]
        order = np.argsort(names)
        # what follows a row is the next chunk's row for the state in which it leaves; the row after all is the end
        follows = np.append(np.searchsorted(names[order], (chunks + 1) * wide + rows[1])[order], len(names))
        follows[:-1][last[chunks[order]]] = len(names)
        count = np.append(count[order], 0)
        for _ in range(int(many.max(initial=1)).bit_length()):
            count = count + count[follows]
            follows = follows[follows]
        return count[np.searchsorted(names[order], first * wide)]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: a mark before it, spaces as marks, words from mark to mark; an empty text has none."""
        marked = [("▁" + x).replace(" ", "▁") if x else "" for x in texts]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        out = np.zeros(len(texts), np.int64)
        if not len(points):
            return out
        first = np.cumsum(sizes) - sizes
        mark = points == MARK
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[first[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points))
        columns = self.classify(points)
        short = ends - starts <= 4 * CHUNK
        total = np.zeros(len(starts), np.int64)
        _, total[short] = self.run(columns, starts[short], ends[short])
        if not short.all():
            total[~short] = self.long_words(columns, starts[~short], ends[~short])
        of = np.repeat(np.arange(len(texts)), sizes)[starts]
        np.add.at(out, of, total)
        return out


_MADE: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a sentencepiece model file; one in a process, kept from task to task."""
    if path not in _MADE:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or trained.model_type != 2 or not trained.byte_fallback:
            raise ValueError("only models that keep texts as they are, with merges and byte fallback")
        scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any("▁" in p.lstrip("▁") for p in scores):
            raise ValueError("a piece has a word mark inside; words can't be counted apart")
        _MADE[path] = Transducer(scores)
    return _MADE[path]


def token_counts(documents: DataFrame, model: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Null and empty texts have 0 bytes and 0 tokens; long texts are counted whole; repeated rows are counted each;
    an empty table gives no rows.  Only the two named columns are read.  The model file is read where it lies on
    each worker (an installed package), and never sent.
    """

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        n = transducer(path).counts([x.decode() for x in texts])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    return map_slices(only(documents, key, text).toDF("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
