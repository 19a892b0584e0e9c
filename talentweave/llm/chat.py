"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to one string.  Nothing is known of it but its outputs:
the prefixes of a conversation are rendered turn after turn, each output is compared with the one before, and what
was added is the span of the new turn.  If an output does not begin with the one before it, the template rewrites
history (as those do that drop or move earlier turns), and no span can be trusted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import only

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The template's control strings; every one begins with < or [.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED, _PLAIN = re.compile(r"\\(.)", re.S), re.compile(r"[\\<\[]")


def escape(text: str) -> str:
    """A backslash before each character with which a control string, or an escape, could begin."""
    return _PLAIN.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def instruct(turns: list[Turn]) -> str:
    """``<s>[INST]role[/INST]text</s>`` for each turn, role and text escaped."""
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


_TURN = re.compile(r"<s>\[INST\]((?:[^\\<\[]|\\.)*)\[/INST\]((?:[^\\<\[]|\\.)*)</s>", re.S)


def read_back(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of every turn in a rendering of ``instruct``."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


class RewritesHistory(ValueError):
    """A longer prefix of the conversation did not keep the rendering of the shorter one."""


def spans(turns: list[Turn], template: Template = instruct) -> Iterator[str]:
    """What each turn adds to the rendering, found from the outputs for successive prefixes, each rendered whole.

    The first turn's span has whatever stands before it, so the spans joined are the whole rendering.
    """
    before = ""
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {k - 1} changes the turns before it")
        yield now[len(before) :]
        before = now


#: Stands for a text to find its place in a rendering.
_PROBE = "\ue000"


def loss_spans(turns: list[Turn], pieces: list[str], template: Template) -> list[tuple[int, int]]:
    """Where the text under the loss mask lies in each turn's piece; (0, 0) for other roles.

    The turn is rendered once more with one rare character as its text: what stands before and after that is the
    template's own.  A template that does not show the character, or changes what is around it, has no span.
    """
    out, done = [], 0
    for k, ((role, _), piece) in enumerate(zip(turns, pieces, strict=True)):
        span = (0, 0)
        if role == "assistant":
            probe = template([*turns[:k], (role, _PROBE)])[done:]
            at = probe.find(_PROBE)
            if at >= 0 and len(piece) >= len(probe) - 1 and piece.startswith(probe[:at]) and piece.endswith(probe[at + 1 :]):
                span = (at, len(piece) - (len(probe) - at - 1))
        out.append(span)
        done += len(piece)
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """All rows of one conversation after the other, from rows in order; the first column tells conversations apart."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pieces(turns: list[Turn], template: Template) -> tuple[list[str], str | None]:
    """The pieces of a conversation, or none and what is wrong with its rendering."""
    try:
        return list(spans(turns, template)), None
    except RewritesHistory as e:
        return [], f"RewritesHistory: {e}"


def digest(batches: Iterator[pa.RecordBatch], template: Template = instruct) -> Iterator[pa.RecordBatch]:
    """One row a conversation from rows in order; holds one conversation, as every prefix of it is rendered."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault"]
        )

    for held in _conversations(batches):
        pieces, fault = _pieces([(role or "", text or "") for _, role, text in held], template)
        if fault:
            rows.append((held[0][0], len(held), None, None, None, None, fault))
        else:
            n, turns, loss, loss_chars = 0, hashlib.sha256(), hashlib.sha256(), 0
            for piece in pieces:
                for role, text, start, end in read_back(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        masked = unescape(piece[start:end])
                        loss.update(masked.encode())
                        loss_chars += len(masked)
            rows.append((held[0][0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), sum(map(len, pieces)), None))
        if len(rows) >= 2000:
            yield out()
            rows = []
    if rows:
        yield out()


def format_conversations(conversations: DataFrame, template: Template = instruct) -> DataFrame:
    """One row a conversation: turns and loss text read back from the rendering, as counts and digests.

    Turns go in order of ``turn`` (null first), ties and repeated rows by role and text, each kept; null role or
    text is empty; a null conv_id is a conversation of its own; an empty table gives no rows.  A conversation whose
    rendering rewrites history has its number of turns and what is wrong in ``fault`` (else null), and no digests;
    the others are not touched by it.  SHA-256 of all turns in order cannot be put together from parts, and every
    prefix is rendered, so one task holds a conversation and its work grows with the square of the conversation's
    length.
    """
    rows = only(conversations, "conv_id", "role", "text", "turn")
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(
        lambda it: digest(it, template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault string"
    )


def formatted(conversations: DataFrame, template: Template = instruct) -> DataFrame:
    """(conv_id, turn, role, piece, loss_start, loss_end, fault): the rendered pieces themselves.

    Pieces are those of ``spans`` over each conversation in the order of ``format_conversations``.
    loss_start and loss_end bound the text under the loss mask inside the piece (both 0 for other roles).  Turns of a
    conversation whose rendering rewrites history have no piece, but the fault.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _conversations(batches):
            pieces, fault = _pieces([(role or "", text or "") for _, _, role, text in held], template)
            marks = [(0, 0)] * len(held) if fault else loss_spans([(role or "", text or "") for _, _, role, text in held], pieces, template)
            pieces = pieces or [None] * len(held)
            ids, turns, roles, _ = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(turns, pa.int64()), pa.array(roles, pa.string()),
                    pa.array(pieces, pa.string()), pa.array([s for s, _ in marks], pa.int64()),
                    pa.array([e for _, e in marks], pa.int64()), pa.array([fault] * len(held), pa.string())
                ],
                ["conv_id", "turn", "role", "piece", "loss_start", "loss_end", "fault"]
            )

    rows = only(conversations, "conv_id", "turn", "role", "text").withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, piece string, loss_start long, loss_end long, fault string")
