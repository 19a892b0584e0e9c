"""Near duplicates and repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from talentweave.llm import common, prefixes, simhash, substrings
from talentweave.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fps, ids, radius):
    v = np.array(fps, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= radius
    label = np.array([2**63 - 1 if i is None else i for i in ids])
    while True:
        new = np.where(near, label[None], 2**63 - 1).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def _texts():
    r = random.Random(4)
    words = ["Alpha", "beta", "Gamma", "delta", "eps", "zeta", "ß", "日本"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    near = [t.replace("beta", "BETA") for t in base[:20]] + [t + " tail" for t in base[20:40]]
    return base + near + [None, "", " \t\n", base[0], base[0], "one", "One\x0b"]


def test_fingerprints_and_components(spark):
    texts = _texts()
    rows = spark.createDataFrame(
        [(i + 100, t) for i, t in enumerate(texts)], "doc_id long, text string"
    ).withColumns({"fp": F.lit("x"), "component": F.lit(1), "lang": F.lit(None).cast("string")}).repartition(5)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(rows).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = dict(zip([i + 100 for i in range(len(texts))], zip(fps, brute_components(fps, [i + 100 for i in range(len(texts))], 4), strict=True), strict=True))
    assert got == want


def test_tiles_find_all_links():
    r = np.random.default_rng(2)
    fps = np.unique(np.concatenate([r.integers(0, 2**63, 1500, dtype=np.uint64), np.uint64(7) << r.integers(0, 60, 300, dtype=np.uint64)]))
    flips = fps[:400] ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, flips]))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    node = np.arange(len(fps))
    linked = set(node[near.sum(1) > 1].tolist())
    a, b = simhash.tile_links(simhash.Tile(fps, node), simhash.Tile(fps, node), 4, True, size=64)
    assert set(a.tolist()) | set(b.tolist()) == linked
    half = len(fps) // 2
    a, b = simhash.tile_links(simhash.Tile(fps[:half], node[:half]), simhash.Tile(fps[half:], node[half:]), 4, False, size=64)
    cross = near[:half, half:]
    assert set(a.tolist()) | set(b.tolist()) == set(node[:half][cross.any(1)].tolist()) | set(node[half:][cross.any(0)].tolist())


def test_similar_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(20):  # two words changed: about ten of 116 shingles
        w = list(base[i])
        w[30], w[80] = word(), word()
        rows.append((100 + i, " ".join(w)))
    rows += [(200, rows[39][1]), (201, None), (202, ""), (None, rows[38][1])]
    got = {d: c for d, c in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {**{i: i for i in range(40)}, **{100 + i: i for i in range(20)}, 200: 39, 201: 201, 202: 201, None: 38}
    assert simhash.wide_radius(1.0, 256) == 0 and simhash.wide_radius(0.8, 256) > simhash.wide_radius(0.9, 256)


def test_links_over_several_tiles(spark):
    r = np.random.default_rng(3)
    fps = np.unique(np.concatenate([r.integers(0, 2**63, 500, dtype=np.uint64), np.arange(300, dtype=np.uint64)]))
    links = simhash.links(spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "node long, fp long"), 4, tile=50)
    of = {r.node: r.component for r in components(links).collect()}
    ids = fps.view(np.int64).tolist()
    want = brute_components(fps, ids, 4)
    assert {i: of.get(i, i) for i in ids} == dict(zip(ids, want, strict=True))


def test_no_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "x y z q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}


def brute_repeats(texts, window=35):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(b" ".join(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def _passages(seed):
    r = random.Random(seed)

    def text():
        letters = "ab" if r.random() < 0.3 else "abcdefghijklmnopqrstuvwxyzé"
        if r.random() < 0.25:
            return " ".join([r.choice(letters)] * r.randint(1, 120) + ["x", "y"] * r.randint(0, 60))
        return " ".join(r.choice(letters) + r.choice(letters) for _ in range(r.randint(0, 200)))

    texts = [text() for _ in range(80)]
    texts += [texts[i][10:180] + " q\n" + texts[i + 1] for i in range(0, 40, 3)] + [None, "", " \n "]
    return texts + [" ".join(texts[5].split()[i : i + 36]) for i in range(3)] + [texts[7], texts[7]]


def test_repeats_equal_brute_force(spark):
    for seed in (1, 2):
        texts = _passages(seed)
        rows = spark.createDataFrame(
            list(enumerate(texts)), "doc_id long, text string"
        ).withColumns({"k1": F.lit(1), "runs": F.lit("x")}).repartition(4)
        got = [tuple(r[1:]) for r in substrings.repeated_passages(rows).orderBy("doc_id").collect()]
        assert got == brute_repeats(texts)


def test_repeats_keep_columns_and_clean_texts(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame(
        [(1, f"own  start {passage} end", "s1", 9), (2, f"{passage}", "s2", 9), (3, "left \n alone", None, 9), (None, None, "s", 9)],
        "doc_id long, text string, source string, n int"
    )
    got = {r.doc_id: r for r in substrings.without_repeats(rows).collect()}
    assert got[1].text == "own start end" and got[2].text == "" and got[3].text == "left \n alone" and got[None].text is None
    assert got[1].source == "s1" and substrings.without_repeats(rows).columns == rows.columns
    assert substrings.repeated_passages(rows.where("false")).count() == 0
    twice = spark.createDataFrame([(1, passage), (1, passage), (1, passage + " other")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.repeated_passages(twice).collect()] == [50, 50, 50]


def _alike(r, vocabulary):
    """Texts in families around one centre, whose pairs lie between 0.4 and 1, some of them with a repeated line."""
    word = lambda: f"w{r.randrange(vocabulary)}"
    texts = []
    for family in range(40):
        base = [word() for _ in range(200)]
        for changes in (0, 2, 3, 5, 7, 9, 12, 15):
            w = list(base)
            for at in r.sample(range(0, 200, 8), changes):
                w[at] = word()
            texts.append(" ".join(w + (["one common line of boiler plate"] * 60 if family % 4 == 0 else [])))
    line = " ".join(f"menu{i}" for i in range(12))
    return texts + [" ".join([line] * 40 + [word() for _ in range(40)]) for _ in range(20)]


def test_similar_links_only_confirmed_pairs(spark):
    texts = _alike(random.Random(12), 10**6)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    sim = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    label = np.arange(len(texts))
    linked = np.array(sim) >= 0.8
    while not ((new := np.where(linked, label[None], len(texts)).min(1)) == label).all():
        label = new
    off = np.array(sim)[np.triu_indices(len(texts), 1)]
    assert min(((off > x) & (off < x + 0.1)).sum() for x in (0.5, 0.6, 0.7, 0.8)) > 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(simhash.similar(rows).collect())
    assert [i for i in range(len(texts)) if label[got[i]] != label[i]] == []  # nothing is together that brute force keeps apart
    assert sum(got[i] != label[i] for i in range(len(texts))) <= 0.02 * len(texts)


def _nodes(spark, sets, labels):
    packed = [(i, np.array(sorted(x), np.int64).tobytes()) for i, x in enumerate(sets)]
    held = spark.createDataFrame(packed, "node long, shingles binary").repartition(3)
    return held, spark.createDataFrame([(i, len(x), labels[i]) for i, x in enumerate(sets)], "node long, n long, label long")


def test_candidates_hold_all_pairs_of_the_similarity(spark):
    r, sets = random.Random(4), []
    for _ in range(30):
        base = [r.randrange(10**9) for _ in range(r.choice([1, 4, 5, 30, 100]))] + r.sample(range(300), r.choice([0, 2, 40]))
        sets.append(set(base))
        for _ in range(6):
            share = r.choice([0.02, 0.08, 0.1, 0.12, 0.2])
            sets.append({x if r.random() > share else r.randrange(10**9) for x in base} | {r.randrange(10**9) for _ in range(r.choice([0, 0, 3, 10]))})
    labels = [i if i % 5 else i - i % 10 for i in range(len(sets))]
    for similarity in (0.8, 0.5):
        got = {frozenset(x) for x in prefixes.candidates(*_nodes(spark, sets, labels), similarity).select("a", "b").collect()}
        want = {
            frozenset((i, j)) for i in range(len(sets)) for j in range(i) if labels[i] != labels[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
        }
        assert want <= got and len(want) > 50


def test_pages_of_one_template_below_the_similarity_do_not_meet(spark):
    """Pairs of 0.7 to 0.79: their number of candidates must not grow with the square of the pages."""
    r = np.random.default_rng(2)
    for pages in (500, 2000):
        sets = []
        for i in range(pages):
            own = int(r.integers(120, 170))  # of 1,000: a similarity of 0.7 to 0.79
            sets.append(set(range(1000 - own)) | set(range(10**6 * (i + 1), 10**6 * (i + 1) + own)))
        assert prefixes.candidates(*_nodes(spark, sets, list(range(pages))), 0.8).count() <= 2 * pages
    text = lambda k: " ".join([f"menu{i}" for i in range(260)] + [f"p{k}w{i}" for i in range(45)])
    rows = spark.createDataFrame([(k, text(k)) for k in range(600)] + [(600, text(5) + " more")], "doc_id long, text string").repartition(4)
    got = dict(simhash.similar(rows).collect())
    assert got == {k: k for k in range(600)} | {600: 5}


def test_only_texts_that_share_a_band_are_compared(spark, monkeypatch):
    """Tiles of fingerprints are compared with each other, so only what has something like it may go there."""
    compared, old = [], simhash.proposals
    monkeypatch.setattr(simhash, "proposals", lambda distinct, *a: compared.append(distinct.count()) or old(distinct, *a))
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    texts += [t + " more" for t in texts[:10]] + ["", None, "two words", "two words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(simhash.similar(rows).collect())
    assert got == {i: i for i in range(414)} | {400 + i: i for i in range(10)} | {411: 410, 413: 412}
    assert compared == [20]


def test_sets_of_the_similarity_share_a_band():
    r = np.random.default_rng(5)
    for similarity in (0.5, 0.8, 0.95):
        shape, found = simhash.bands_for(similarity), 0
        for _ in range(300):
            n = int(r.choice([20, 100, 1000]))
            both = int(np.ceil(similarity * n))
            x = r.integers(1, 2**63, 2 * n - both, np.int64).view(np.uint64)
            keys = simhash.band_keys([x[:n - (n - both) // 2], np.concatenate([x[:both], x[n - (n - both) // 2 : n]])], *shape)
            found += bool((keys[0] == keys[1]).any())
        assert found >= 299
    assert simhash.bands_for(0.8) == (4, 20)
    far = simhash.band_keys([r.integers(1, 2**63, 200, np.int64).view(np.uint64) for _ in range(200)], 4, 20)
    assert len(np.unique(far)) == far.size


def test_blocks_hold_bounded_sets():
    r = np.random.default_rng(1)
    p, q = np.sort(r.integers(0, 50, 300)), r.integers(50, 100, 300)
    size = r.integers(1, 40, 100)
    out = [(nodes[a], nodes[b], size[nodes].sum()) for nodes, a, b in simhash._fitting(p, q, size[p], size[q], 500)]
    assert np.array_equal(np.concatenate([x[0] for x in out]), p) and np.array_equal(np.concatenate([x[1] for x in out]), q)
    assert len(out) > 1 and max(x[2] for x in out) <= 500


def test_repeats_inside_one_run(spark):
    """An own line that comes every few words, so that its symbol may win in all windows, and a passage that comes twice."""
    r = random.Random(7)
    fresh = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    texts, inside = [], 0
    for _ in range(80):
        line = fresh(8)
        unit = lambda: line + fresh(5)  # noqa: E731, B023
        passage = unit() + unit() + unit()
        texts.append(" ".join(passage + unit() + unit() + passage))
        names, _, of, bounds = substrings._tokens([texts[-1].encode()])
        best, periodic = substrings.window_symbols(names, of, bounds, 35)
        inside += len(set(best[: 65 + 39 - 34].tolist())) == 1 and not periodic.any()
    assert inside > 0
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(x[1:]) for x in substrings.repeated_passages(rows).orderBy("doc_id").collect()]
    assert got == brute_repeats(texts) and all(x[1] >= 78 for x in got)


def test_a_passage_of_every_slice_has_two_counted_rows_a_task():
    r = random.Random(3)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage, sent, rows = fresh(40), substrings.Sent(), substrings.Sent()
    counted, known, all_ = collections.Counter(), 0, 0
    for k in range(300):
        texts = [f"{fresh(30)} {passage} {fresh(30)}".encode(), fresh(60).encode()]
        part = pa.RecordBatch.from_arrays([pa.array([b.decode() for b in texts]), pa.array([2 * k, 2 * k + 1]), pa.array([0, 0])], ["text", "k1", "k2"])
        out = substrings._runs(part, texts, 35, sent, rows)
        counted.update(x for x, y in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True) if y == 0)  # its key is the symbol
        known += sum(out.column(6).to_pylist())
        all_ += out.num_rows
    hot = [n for n in counted.values() if n > 1]
    assert hot and max(hot) == 2 and known >= 299 and len(counted) < all_


def test_hot_symbols_are_spread(spark, monkeypatch):
    r = random.Random(3)
    fresh = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    header, after = fresh(9), [fresh(40) for _ in range(30)]
    texts = [" ".join(fresh(r.randint(5, 60)) + header + (r.choice(after) if i % 3 else fresh(40)) + header) for i in range(240)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substrings, "HOT", 100)
    assert [tuple(x[1:]) for x in substrings.repeated_passages(rows).orderBy("doc_id").collect()] == brute_repeats(texts)

    data = [t.encode() for t in texts]
    part = pa.RecordBatch.from_pydict({"text": texts, "k1": pa.array(range(240), pa.int64()), "k2": pa.array(range(240), pa.int64())})
    runs = substrings._runs(part, data, 35, substrings.Sent(), substrings.Sent()).to_pylist()
    most, where = {}, {}
    for hot in (False, True):
        held = [[{"sym": x["sym"] or x["key"], "start": x["start"], "size": x["size"], "hot": hot} for x in runs if x["k1"] == k] for k in range(240)]
        kind = pa.list_(pa.struct([("sym", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("hot", pa.bool_())]))
        out = substrings._candidates(part.append_column("runs", pa.array(held, kind)), data, 35, substrings.Sent(), substrings.Sent()).to_pylist()
        windows = collections.Counter()
        for x in out:
            windows[x["key"]] += len(x["hashes"]) // 8
        most[hot] = max(windows.values())
        where[hot] = {(x["k1"], x["start"] + i): x["hashes"][8 * i : 8 * i + 8] + x["known"][i : i + 1] for x in out for i in range(len(x["known"]))}
    assert most[False] > 200 and most[True] == 1 and where[True] == where[False]


def test_repeated_rows_are_linear(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    one, two, short = text(300), text(80), text(10)
    rows = [(1, one)] * 10_000 + [(None, two)] * 3000 + [(3, short)] * 20 + [(4, one + " " + short), (5, text(60)), (None, None), (None, None)]
    want = dict(zip([(1, 300), (None, 80), (3, 10), (4, 310), (5, 60), (None, 0)], [300, 80, 0, 300, 0, 0], strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for least in (1000, 10**9):  # dealt to several places, and not
        monkeypatch.setattr(substrings, "REPEATED", least)
        got = substrings.repeated_passages(df).collect()
        assert len(got) == len(rows) and {(x.doc_id, x.n_words): x.n_removed for x in got} == want


def test_tasks_remember_what_they_sent():
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(50)) + " " + passage for _ in range(12)]
    sent, rows = substrings.Sent(), []
    for i in range(0, 12, 3):
        part = pa.RecordBatch.from_pydict({"text": texts[i : i + 3], "k1": pa.array(range(i, i + 3)), "k2": pa.array(range(i, i + 3))})
        rows += substrings._runs(part, [t.encode() for t in texts[i : i + 3]], 35, sent, substrings.Sent()).to_pylist()
    shared = [x for x in rows if x["known"]]
    assert {x["k1"] for x in shared} == set(range(12))
    most = max(sum(x["key"] == y and x["sym"] == 0 for x in shared) for y in {x["key"] for x in shared})
    assert most <= 2


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"aa bb cc aa", np.uint8)
    monkeypatch.setattr(common, "span_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    code, first = common.span_codes(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11]))
    assert code.tolist() == [0, 1, 2, 0] and first.tolist() == [0, 1, 2]


def test_one_of_each_group(spark):
    text = "a b c d e f g h i j"
    rows = [(60, text, "en", 1), (60, text, "en", 1), (60, text, "de", 0), (None, text, "en", 1), (61, text, None, None)]
    rows += [(None, "null id text of its own here", "x", i) for i in (3, 2, 2)] + [
        (7, None, "n", 0), (8, "", "n", 0), (9, "another text that stands alone", None, None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, component long").repartition(3)
    want = [(60, text, "de", 0), (None, "null id text of its own here", "x", 2), (7, None, "n", 0), (9, "another text that stands alone", None, None)]
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert simhash.one_of_each(df.where("false")).count() == 0
    many = spark.createDataFrame([(1, text)] * 3000 + [(None, "x y z")] * 500, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, simhash.one_of_each(many).collect()), key=str) == sorted([(1, text), (None, "x y z")], key=str)
