"""Annotation of texts with the terms of any lexicon, and equivalence of named skills.

A lexicon is a table (canonical, alias, category, ord).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talentweave.functions.text import distinct_sorted, fold, let, squeeze
from talentweave.operators.sizes import settled

#: Up to so many aliases become one column expression.
INLINE_ALIASES = 200
#: Larger lexicons of up to so many letters (all aliases and terms) become an automaton, of which each worker holds one
#: (some 60 bytes a letter at most); those beyond are joined.
AUTOMATON_LETTERS = 4 << 20
#: Bits of what tells which runs of tokens may be joined: of beginnings of one or two tokens, of longer ones and of whole aliases (16 MB each).
STARTS, INNER = 1 << 25, 1 << 27
# Short tokens that count in comparisons of skills, and rewritings before them.
SHORT_TOKENS = ("c#", "c++", "ci", "ai", "ml", "ui", "ux")
REWRITTEN = (("c plus plus", "c++"), ("c sharp", "c#"))


def term_condition(folded: Column, aliases: list[str]) -> Column:
    """Whether any alias stands in the folded text without a letter or digit beside it."""
    names = sorted({" ".join(a.split()).lower().replace("ß", "ss") for a in aliases} - {""})
    # a plain search for the letters is much cheaper than the pattern, and most terms are in few texts
    there = F.lit(False)
    for name in names:
        there = there | folded.contains(name)
    any_of = "|".join(map(re.escape, names))
    return there & folded.rlike(f"(?<![a-z0-9])(?:{any_of})(?![a-z0-9])")


def terms_of(folded: Column, lexicon: dict[str, list[str]]) -> Column:
    """Sorted array of the canonical terms of a small lexicon found in a text that is folded and squeezed already."""
    found = [F.when(term_condition(folded, aliases), F.lit(name)) for name, aliases in sorted(lexicon.items()) if any(a.strip() for a in aliases)]
    return distinct_sorted(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def terms_column(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Sorted array of the canonical terms of a small lexicon found in a text."""
    return let(fold(squeeze(text)), lambda folded: terms_of(folded, lexicon))


# The automaton of the lexicon that this worker used last: (its name, the automaton, terms by number, and their folded forms by number).
_COMPILED: list[tuple[str, ahocorasick.Automaton, list[str], list[int]]] = []
_PIECES = re.compile(" ?(?:[a-z0-9]+|[^a-z0-9 ])")
_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _compiled(name: str, lexicon: Broadcast) -> tuple[str, ahocorasick.Automaton, list[str], list[int]]:
    """Aliases as a trie with failure links, whose ends hold (length, numbers of terms)."""
    if not _COMPILED or _COMPILED[0][0] != name:
        order = sorted({(folded, term) for _, term, folded in lexicon.value})
        number = {pair: i for i, pair in enumerate(order)}
        by_alias: dict[str, list[int]] = {}
        for alias, term, folded in lexicon.value:
            by_alias.setdefault(alias, []).append(number[folded, term])
        machine = ahocorasick.Automaton()
        for alias, numbers in by_alias.items():
            machine.add_word(alias, (len(alias), tuple(numbers)))
        machine.make_automaton()
        forms = {folded: i for i, folded in enumerate(dict.fromkeys(folded for folded, _ in order))}
        _COMPILED[:] = [(name, machine, [term for _, term in order], [forms[folded] for folded, _ in order])]
    return _COMPILED[0]


def found_terms(text: str, machine: ahocorasick.Automaton, terms: list[str], forms: list[int]) -> list[str]:
    """Terms of all aliases that stand in the text without a letter or digit beside, in order; of equal folded forms the first."""
    numbers: set[int] = set()
    for end, (size, hit) in machine.iter(text):
        before, after = end - size, end + 1
        if (before < 0 or text[before] not in _BESIDE) and (after == len(text) or text[after] not in _BESIDE):
            numbers.update(hit)
    by_form: dict[int, str] = {}
    for i in sorted(numbers):
        by_form.setdefault(forms[i], terms[i])
    return list(by_form.values())


def terms_by_automaton(folded: Column, lexicon: Broadcast) -> Column:
    """Sorted terms of a broadcast lexicon, rows (folded alias, term, folded term), in texts that are folded and squeezed.

    Each text is walked once, whatever the number of aliases; a worker compiles the lexicon once.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        _, machine, terms, forms = _compiled(name, lexicon)
        return texts.map(lambda t: found_terms(t, machine, terms, forms))

    return find(folded)


def _bits(names: DataFrame, tokens: Column, bits: int) -> bytearray:
    """A bitmap of at most ``bits``, whatever the lexicon's size, in which the place of each CRC of ``tokens`` (arrays) is set."""
    at = F.pmod(F.crc32("v"), F.lit(bits)) + 1
    rows = names.select(F.explode(tokens).alias("v")).groupBy(F.bitmap_bucket_number(at).alias("b"))
    out = bytearray(bits >> 3)
    for r in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return out


def _runs_of(text: str, longest: int, starts: bytes, inner: bytes, whole: bytes) -> set[str]:
    """Runs of tokens of which each beginning may be one of an alias and the whole an alias; none that is one is missing."""
    tokens, out = _PIECES.findall(text), set()
    raw = [t.encode() for t in tokens]
    for i, token in enumerate(tokens):
        # no letter or digit stands beside a run: where its own first or last sign is none, the neighbour decides
        if i and token[0] != " " and tokens[i - 1][-1] in _BESIDE:
            continue
        crc = zlib.crc32(raw[i].lstrip(b" "))
        for n in range(1, min(longest, len(tokens) - i) + 1):
            if n > 1:
                crc = zlib.crc32(raw[i + n - 1], crc)
            held, place = (starts, crc % STARTS) if n < 3 else (inner, crc % INNER)
            if not held[place >> 3] >> (place & 7) & 1:
                break
            place, end = crc % INNER, i + n
            if whole[place >> 3] >> (place & 7) & 1 and (end == len(tokens) or tokens[end][0] not in _BESIDE):
                out.add("".join(tokens[i:end]).lstrip(" "))
    return out


def _joined(df: DataFrame, text: str, names: DataFrame, out: str, key: str) -> DataFrame:
    """Terms by joining the aliases to the runs of one to several tokens of each text.

    Bitmaps of the aliases and of their beginnings, of a size that the lexicon does not change, drop runs that are no
    alias where they are made; the join decides about the others.
    """
    held = settled(names.select("alias", F.regexp_extract_all("alias", F.lit(f"({_PIECES.pattern})"), 1).alias("t")), "aliases")
    longest = held.agg(F.max(F.size("t"))).first()[0] or 1
    begun = lambda a, b: F.expr(f"transform(filter(sequence(1, greatest(size(t), 1)), n -> n between {a} and {b}), n -> array_join(slice(t, 1, n), ''))")
    maps = _bits(held, begun(1, 2), STARTS), _bits(held, begun(3, longest), INNER), _bits(held, F.array("alias"), INNER)
    shared = df.sparkSession.sparkContext.broadcast(tuple(map(bytes, maps)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                mine = _runs_of(value, longest, *shared.value)
                at += [i] * len(mine)
                runs += mine
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(runs, pa.string())], names=[key, "alias"])

    texts = df.select(key, fold(squeeze(F.col(text))).alias("t"))
    schema = StructType([df.schema[key], StructField("alias", StringType())])
    found = texts.mapInArrow(run, schema).hint("merge").join(names.hint("merge"), "alias").groupBy(key).agg(distinct_sorted(F.array_sort(F.collect_set("canonical"))).alias(out))
    return df.hint("merge").join(found, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def annotate_terms(df: DataFrame, text: str, lexicon: DataFrame, out: str = "terms", key: str = "id") -> DataFrame:
    """``df`` with a column of the sorted canonical terms in ``text``; null and empty texts have none.

    The lexicon's size is looked at first.  One of at most INLINE_ALIASES aliases is one narrow expression; one of at
    most AUTOMATON_LETTERS letters an automaton that walks each text once and moves no rows; a larger one is joined to
    the runs of one to several tokens of each text, and ``key`` then names the rows.
    """
    term = squeeze(F.col("canonical"))
    names = lexicon.select(fold(squeeze(F.col("alias"))).alias("alias"), term.alias("canonical"), fold(term).alias("form"))
    names = names.where("alias <> '' and canonical <> ''").distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("alias") + F.length("canonical")), F.lit(0)).alias("letters")).first()
    if size["n"] > INLINE_ALIASES and size["letters"] > AUTOMATON_LETTERS:
        return _joined(df, text, names.select("canonical", "alias"), out, key)
    # a column of its own is computed once a row, and the patterns stay in generated code
    df = df.withColumn("_folded", fold(squeeze(F.col(text))))
    held = [tuple(row) for row in names.collect()]  # at most INLINE_ALIASES rows or AUTOMATON_LETTERS letters
    if len(held) > INLINE_ALIASES:
        return df.withColumn(out, terms_by_automaton(F.col("_folded"), df.sparkSession.sparkContext.broadcast(held))).drop("_folded")
    table: dict[str, list[str]] = {}
    for alias, canonical, _ in sorted(held):
        table.setdefault(canonical, []).append(alias)
    return df.withColumn(out, terms_of(F.col("_folded"), table)).drop("_folded")


def in_categories(terms: Column, lexicon: dict[str, str], categories: tuple[str, ...]) -> Column:
    """The terms whose category is one of the given."""
    chosen = sorted(name for name, c in lexicon.items() if c in categories)
    return F.array_intersect(terms, F.array(*[F.lit(x) for x in chosen]).cast("array<string>"))


def skill_phrase(c: Column) -> Column:
    text = fold(squeeze(c))
    for a, b in REWRITTEN:
        text = F.replace(text, F.lit(a), F.lit(b))
    return squeeze(F.regexp_replace(text, "[^a-z0-9+#]+", " "))


def _described(names: DataFrame, lexicon: DataFrame, side: str) -> DataFrame:
    """(side, canonical, phrases, tokens) for each distinct name."""
    phrases = lexicon.select(
        "canonical", F.col("ord").cast("long").alias("ord"),
        F.explode(F.array(skill_phrase(F.col("canonical")), skill_phrase(F.col("alias")))).alias("phrase")
    ).where("phrase <> ''")
    known = phrases.groupBy("phrase").agg(F.max_by("canonical", "ord").alias("canonical"))  # later entries win
    every = phrases.groupBy("canonical").agg(F.collect_set("phrase").alias("known"))
    rows = names.select(F.col("name").alias(side)).where(f"{side} is not null").distinct().withColumn("phrase", skill_phrase(F.col(side)))
    rows = rows.join(known.hint("merge"), "phrase", "left").withColumn("entry", F.col("canonical")).withColumn(
        "canonical", F.when(F.col("phrase") == "", "").otherwise(fold(F.coalesce("canonical", squeeze(F.col(side)))))
    )
    rows = rows.join(every.withColumnRenamed("canonical", "entry").hint("merge"), "entry", "left")
    rows = rows.withColumn(
        "phrases",
        F.filter(F.array_distinct(F.concat(F.coalesce("known", F.array().cast("array<string>")), F.array("phrase"))), lambda x: x != "")
    )
    token = F.array_distinct(F.flatten(F.transform("phrases", lambda p: F.split(p, " "))))
    return rows.select(side, "canonical", "phrases", F.filter(token, lambda t: (F.length(t) >= 3) | t.isin(*SHORT_TOKENS)).alias("tokens"))


def _holders(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of which all tokens of a name of ``small`` are tokens of the name of ``large``.

    A name that holds another's tokens holds the rarest of them, so each name of ``small`` looks under that one alone;
    tokens that most names have bring no rows together.
    """
    a, b = small.columns[0], large.columns[0]
    held = large.select(b, F.col("tokens").alias("_held"), F.explode("tokens").alias("_token"))
    often = held.groupBy("_token").agg(F.count("*").alias("_n"))
    each = small.select(a, "tokens", F.explode("tokens").alias("_token")).join(often.hint("merge"), "_token")
    rarest = each.groupBy(a).agg(F.min_by("_token", F.struct("_n", "_token")).alias("_token"), F.first("tokens").alias("tokens"))
    return rarest.hint("merge").join(held, "_token").select(a, b, (F.size(F.array_except("tokens", "_held")) == 0).alias("alike"))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, alike): what has to be compared; names of one canonical term or with a common phrase are alike as they are."""
    keys = F.array_distinct(F.concat(F.when(F.col("canonical") != "", F.array(F.concat(F.lit("="), "canonical"))).otherwise(F.array().cast("array<string>")), F.col("phrases")))
    same = a.select("left", F.explode(keys).alias("key")).hint("merge").join(b.select("right", F.explode(keys).alias("key")), "key")
    rows = same.select("left", "right", F.lit(True).alias("alike"))
    return rows.unionByName(_holders(a, b)).unionByName(_holders(b, a))


def skill_pairs(left: DataFrame, right: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(left, right): all equivalent names of two tables with a column ``name``.

    Equivalent are names of one canonical term, with a common phrase, of which one's tokens hold the other's, or
    with two common tokens that are all of the smaller; it is symmetric but not transitive.  Candidates share a
    phrase, a canonical term, or the rarest token of one of them, so the joins grow with the names and the pairs.
    """
    a, b = (settled(_described(rows, lexicon, side), side) for rows, side in ((left, "left"), (right, "right")))
    return _paired(a, b).where("alike").select("left", "right").distinct()
