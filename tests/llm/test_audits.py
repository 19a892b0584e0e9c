"""Repeated lines, interaction of filters and divergence of sources against plain Python, and on rows of all kinds."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.llm import divergence, interaction, lines

SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("k1", "k2", "line", "lines", "drops", "pos", "h1", "n", "part", "mask", "words", "term", "rank", "p", "q", "no", "least", "first", "good", "label")


def _frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    return df.repartition(3)


# ---- lines ---------------------------------------------------------------------------------------------------
def _kept(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    name = lambda d, t: (1, t or "") if d is None else (0, d)
    held = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(name(d, t))
    out = []
    for d, t, *_ in rows:
        split = (t or "").split("\n")
        keep = [x for x in split if len(key(x)) < 10 or len(held[key(x)]) < 2 or (name(d, t) == min(held[key(x)]) and name(d, t)[0] == 0)]
        out.append((d, "\n".join(keep), len(split), len(split) - len(keep)))
    return sorted(out, key=str)


def test_lines(spark):
    r = random.Random(1)
    pool = ["A common line here", "  a COMMON line HERE\t", "Ärger mit Ümlauten", "ärger mit Ümlauten", "short", "", " ", "exactly 10", "exactly 9", "\x0bline with ends\x0c", "Line With Ends", "ſtrange K sign İ"]
    rows = [(i, "\n".join(r.choice(pool + [f"line of its own {i} {j}" for j in range(6)]) for _ in range(r.randint(1, 12))), None, None) for i in r.sample(range(1000), 60)]
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "\n\n", None, None), (2003, "one more line\n" * 400, None, None), rows[3], rows[3], (None, None, None, None)]
    got = sorted((tuple(x) for x in lines.without_repeated_lines(_frame(spark, rows)).collect()), key=str)
    assert got == _kept(rows)
    assert lines.without_repeated_lines(_frame(spark, rows).where("false")).count() == 0


def test_lines_of_rows_without_an_id_and_other_thresholds(spark):
    rows = [(None, "the same line here\nalpha alpha", "", ""), (None, "the same line here\nbeta beta beta", "", ""), (None, "the same line here\nbeta beta beta", "", ""), (7, "x\nthe same line here", "", "")]
    got = lines.without_repeated_lines(_frame(spark, rows)).collect()
    assert sorted((x.text for x in got)) == ["alpha alpha", "beta beta beta", "beta beta beta", "x\nthe same line here"]
    few = lines.without_repeated_lines(_frame(spark, rows), least=4).collect()
    assert all(x.n_dropped == 0 for x in few)  # three documents hold it: the two without an id that are equal are one
    one = [x for x in lines.without_repeated_lines(_frame(spark, rows[:3])).collect() if "the same" in x.text]
    assert len({x.text for x in one}) == 1  # only documents without an id: one of them keeps it


# ---- filters -------------------------------------------------------------------------------------------------
def _audit(rows, labels):
    first = {}
    for d, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", (True, 0)), (d is None, d or 0))
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    parts = collections.defaultdict(list)
    for d, t, _, s in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {x for x, y in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t or "")) > 2 * len(t or ""),
            bool(re.search(r"[#$%&*|]", t or "")), (d is None, d or 0) > first[t or ""]
        ), strict=True) if y}
        parts[s or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [v for v in left if x in v[0]]
                shapley[x] += len(gone)
                kept = [v for v in left if x not in v[0]]
                failing = sum(x in v[0] for v in docs)
                out[part, order, step] = [len(kept), len(gone), failing - len(gone), sum(v[0] == {x} for v in docs), sum(v[1] for v in gone), sum(v[2] for v in gone)]
                left = kept
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_interaction_of_filters(spark):
    r = random.Random(2)
    text = lambda: " ".join(r.choice(["alpha", "Beta", "GAMMA", "delta#", f"w{r.randrange(900)}"]) for _ in range(r.choice([3, 199, 200, 260])))
    rows = [(i, text(), "en", r.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[r.randrange(60)][1], "en", r.choice(["a", "c"])) for i in range(25)]
    rows += [(200, None, None, "a"), (201, "", None, "d"), (None, rows[0][1], None, "a"), (None, "only here", None, "a"), (None, "only here", None, "a"), rows[5], rows[5], (5, "other text, same id", "en", "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 100, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(x[:3]): tuple(x[3:]) for x in interaction.audit(_frame(spark, rows), marks).collect()}
    want = _audit(rows, labels)
    assert got == want and len(got) == 600 * len({s or "" for *_, s in rows})
    assert interaction.audit(_frame(spark, rows).where("false"), marks).count() == 0
    assert interaction.audit(_frame(spark, rows[:3]), marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_intervals_cover_each_order_once_a_step():
    seen = collections.Counter()
    for mask, step, begin, end, entered, removed, redundant, unique in interaction.intervals():
        for rank in range(begin, end):
            order = interaction.ORDERS[rank]
            bit = lambda x: mask >> "ABCDE".index(x) & 1  # noqa: E731, B023
            gone = any(map(bit, order[: step - 1]))
            assert (removed, redundant) == (bit(order[step - 1]) and not gone, bit(order[step - 1]) and gone) and entered == 1
            assert unique == (mask == 1 << "ABCDE".index(order[step - 1]))
            seen[mask, step, rank] += 1
    assert len(seen) == 32 * 5 * 120 and set(seen.values()) == {1}


# ---- sources -------------------------------------------------------------------------------------------------
def _divergence(rows, first=200, least=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for _, t, g, s in rows:
        terms = [x.translate(lower) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        counts[g or "", s or ""].update(terms)
        docs.update((g or "", x) for x in set(terms))
        groups.add((g or "", s or ""))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [x for g, x in docs if g == lang and docs[g, x] >= least]
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c[y] for y in kept) + len(kept)) for x in kept}  # noqa: E731, B023
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), collections.Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(far(p[s][x], p[o][x]) for x in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-far(p[s][x], q[x]), x.encode(), x) for x in kept if counts[lang, s][x] and p[s][x] > q[x])[:first]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("first, block, pairs, groups", [(200, 1024, 1 << 20, 10_000), (3, 8, 40, 10_000), (5, 16, 7, 0)])
def test_divergence_of_sources(spark, monkeypatch, first, block, pairs, groups):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", groups)
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("Ab", "éa", "zz", "日本", "x́") for b in "abcdefghijkl"]
    weight = {s: [r.random() ** 3 for _ in words] for s in range(5)}
    rows = [(i, " ".join(r.choices(words, weight[i % 5], k=r.randint(0, 60))), ("en", "de", None)[i % 3], (f"s{i % 5}", "É", None, "", "b")[i % 5]) for i in range(90)]
    rows += [(300, None, "en", "empty"), (301, "", "fr", "alone"), (302, "lonely words", "fr", "other"), (303, "123 _ .", "it", "only"), rows[4], rows[4], (None, "Aba aba ABA", "en", "s0")]
    got = [tuple(x) for x in divergence.audit(_frame(spark, rows), first).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == _divergence(rows, first)
    if first == 3:
        assert divergence.audit(_frame(spark, rows).where("false")).count() == 0


def test_skyband_keeps_what_fewer_than_k_dominate():
    r = random.Random(6)
    rows = sorted((-r.randrange(1, 9), r.randrange(3, 12), f"t{i}".encode()) for i in range(400))  # a term has one row
    band, kept = divergence.Skyband(4), []
    for i in range(0, len(rows), 50):
        part = rows[i : i + 50]
        of_all, terms = np.array([x[1] for x in part]), np.array([x[2] for x in part], object)
        now = band.keep(of_all, terms)
        band.add(of_all[now], terms[now])
        kept += [x for x, y in zip(part, now.tolist(), strict=True) if y]
    assert kept == [x for x in rows if sum(y[0] <= x[0] and y[1] <= x[1] and y[2] < x[2] for y in rows) < 4]
