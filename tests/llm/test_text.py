"""Encoding, token counts, fingerprints, mixing, chat, pages, quality, search."""

import collections
import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from talentweave.llm import ann, bpe, chat, digest, html, mixing, quality, queries, transducer

EDGE = [
    None, "", " ", "  a", " " * 100, "it's we're 's ''s \"'s I'll'd x 're' r' 'r 'l 'v", "don't\n\n  x\n y \n", "a" * 3000,
    "日本語 12345 ½", "é́\x00 z", " x y  z", "🙂🙂 a🙂", "<s> x</s><|endoftext|>", "▁▁ ▁x", "ab" * 900, "'", " '",
    "x" * 3000 + " " * 3000 + "y"
]


def _random_texts(n, seed=1, alphabet="ab 'srt\n\t  1é.!日ll▁"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({
        "ids": F.lit(3), "n_tokens": F.lit(None).cast("int")
    })


def test_byte_pairs_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = EDGE + _random_texts(400)
    got = {r.doc_id: r for r in bpe.round_trip(_rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        ), t
    back = {r.doc_id: (r.ids, r.decoded) for r in bpe.encoded(_rows(spark, texts[:30])).collect()}
    assert all(back[i] == (library.encode_ordinary(t or ""), t or "") for i, t in enumerate(texts[:30]))
    assert bpe.round_trip(_rows(spark, []).limit(0)).count() == 0


def test_frequent_pieces_are_learnt_once(spark, monkeypatch):
    """A worker that forgets keeps what keeps coming, and a query is made for the new pieces of several parts."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    asked, encode = [], bpe.Encoder.encode
    monkeypatch.setattr(bpe.Encoder, "encode", lambda self, pieces, *a: asked.append(list(pieces)) or encode(self, pieces, *a))
    monkeypatch.setattr(bpe, "KEPT", 40)
    monkeypatch.setattr(bpe, "PART", 100, raising=False)
    monkeypatch.setattr(bpe, "STAY", 20, raising=False)
    pieces, out = bpe.Pieces(path), []
    for i in range(20):
        texts = [f" the word that comes x{''.join(chr(97 + (7 * i + j * k) % 26) for k in range(9))}" for j in range(5)]
        pieces.encode([t.encode() for t in texts], lambda ids, decoded: out.append((ids.tolist(), decoded)))
    assert [d.decode().split()[0] for _, d in out] == ["the"] * 100
    flat = [x for some in asked for x in some]
    assert flat.count(b" word") == 1 and len(asked) == 20
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert all(ids == library.encode_ordinary(d.decode()) for ids, d in out)


def test_sure_pairs_go_in_one_round(spark):
    """Pairs that nothing beside them can stop are contracted together, also in runs of one letter and in long pieces."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(4)
    pieces = [b"llll", b" lllles", b"Rallll", b"l" * 3000] + ["".join(r.choice(a) for _ in range(n)).encode() for a in ("l", "ab", "thernd", "étioné") for n in (2, 5, 9, 40, 1500)]
    ids, counts, decoded, sizes = bpe.encoder(path).encode(pieces)
    assert decoded == b"".join(pieces) and sizes.tolist() == list(map(len, pieces))
    at = np.append(0, np.cumsum(counts))
    for i, p in enumerate(pieces):
        assert ids[at[i] : at[i + 1]].tolist() == library._encode_single_piece(p), p
    rules = bpe.merge_rows(bpe.read_ranks(path))
    sure = [not any(x) for x in rules.column("before").to_pylist()]
    assert sum(sure) > len(sure) // 10


def test_counts_equal_the_library(spark, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(7)
    texts = EDGE + _random_texts(400) + ["".join(r.choice("abcdefgh") for _ in range(9000)), "é" * 5000 + "x" * 2100]
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in transducer.token_counts(_rows(spark, texts)).collect()}
    want = [len(library.encode(t or "")) for t in texts]
    assert got == {i: (len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(texts, want, strict=True))}
    machine = transducer.Transducer(transducer.transducer(public_tokenizers.path("piece_bpe_32k.model")).scores)
    monkeypatch.setattr(transducer, "CELLS", 100)  # the table starts anew again and again
    assert [int(machine.counts([t or ""])[0]) for t in texts[:200]] == want[:200]
    monkeypatch.setattr(transducer, "PAIRS", 10)
    assert machine.counts([t or "" for t in texts]).tolist() == want
    monkeypatch.setattr(transducer, "LEAD", 0)  # no chunk is entered as suggested
    monkeypatch.setattr(transducer, "CHUNK", 16)
    assert machine.counts([t or "" for t in texts]).tolist() == want


def test_counts_of_many_characters_in_bounded_memory():
    code = """
import resource, sentencepiece, public_tokenizers
from talentweave.llm import transducer
path = public_tokenizers.path("piece_bpe_32k.model")
points = [c for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000][:100_000]
texts = ["".join("ab"[i % 2] * (i % 3) + chr(c) for i, c in enumerate(points)), "".join(map(chr, points))]
machine = transducer.transducer(path)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = machine.counts(texts).tolist()
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
library = sentencepiece.SentencePieceProcessor(model_file=path)
assert got == [len(library.encode(t)) for t in texts], got
"""
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), check=True)


def test_mix_is_near_its_targets(spark):
    r = random.Random(3)
    docs = [(i, "w " * r.randint(0, 40), r.choice(["a", "b", "c", "d", "é", None])) for i in range(400)] + [(7, "same words here", "a")] * 3 + [
        (None, "x y", "a"), (500, None, "e"), (501, "one", "zz")
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({
        "name": F.lit("x"), "rest": F.lit(1), "size": F.lit("s")
    })
    got = mixing.mix(rows.repartition(5)).toPandas()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = mixing.shares(sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(targets[s] <= 2 * n + 1e-9 for s, n in sizes.items())
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(docs)
    by = got.groupby(["source_size", "target"]).taken.sum()
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 2
    assert got.sort_values(list(got.columns)).reset_index(drop=True).equals(
        mixing.mix(rows.repartition(3)).toPandas().sort_values(list(got.columns)).reset_index(drop=True)
    )
    mixed = mixing.repeated(rows)
    assert mixed.columns == rows.columns
    assert mixing.mix(rows.where("false")).count() == 0


def test_shares_stop_at_twice_the_size():
    got = mixing.shares({"a": 10, "b": 100, "c": 100, None: 5})
    assert got["a"] == 20 and got[None] == 10 and sum(got.values()) == pytest.approx(1.5 * 215)
    assert mixing.shares({}) == {} and mixing.shares({"a": 0}) == {"a": 0.0}


def test_chat_reads_back(spark):
    talk = [
        (1, 0, "user", "hi <s>[INST] \\ x"), (1, 1, "assistant", "[/INST]</s>é"), (1, 1, "assistant", None), (2, 5, None, "z"),
        (2, 3, "system", ""), (None, 0, "assistant", "n")
    ]
    talk += [(3, i, "assistant" if i % 2 else "user", f"t{i}<") for i in range(300)]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).repartition(4)
    got = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t[1], t[2] or "", t[3] or "") for t in talk if t[0] == conv), key=lambda t: (t[0], t[1], t[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.instruct([(a, t) for _, a, t in turns]))
    pieces = chat.formatted(rows.where("conv_id = 1")).orderBy("turn").collect()
    assert chat.unescape(pieces[1].piece[pieces[1].loss_start : pieces[1].loss_end]) in ("[/INST]</s>é", "")
    assert chat.format_conversations(rows.where("false")).count() == 0


def test_chat_finds_templates_that_rewrite():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert "".join(chat.spans(turns)) == chat.instruct(turns)
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns, lambda ts: "".join(t for r, t in ts if r == "user") + f"#{len(ts)}"))


def test_added_conversation(spark, tmp_path):
    spark.createDataFrame(
        [(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"
    ).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].loss_chars == len(said)


def test_digests(spark):
    r = random.Random(5)
    texts = [
        "".join(r.choice("abcdefghij ößé,.\n") for _ in range(r.choice([0, 5, 70, 200, 900, 4000]))) for _ in range(60)
    ] + ["same " * 400, "same " * 400, "", None]
    rows = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("bucket", F.lit(1)).repartition(6)
    got = {x.doc_id: x for x in digest.fingerprints_with_edits(rows).collect()}
    order = sorted(got, reverse=True)
    assert len(order) == len(texts)
    for i, d in enumerate(order):
        own, following = texts[d // 3] or "", texts[order[(i + 1) % len(order)] // 3] or ""
        new = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    long = [d for d in order if len(texts[d // 3] or "") == 4000]
    assert np.mean([got[d].near_edited for d in long]) > 0.3 > np.mean([got[d].near_next for d in long])
    assert got[180].fingerprint == got[183].fingerprint
    one = digest.fingerprints_with_edits(rows.where("doc_id = 180")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert digest.fingerprints_with_edits(rows.where("false")).count() == 0
    same = spark.createDataFrame([(1, "a" * 100), (1, "a" * 100), (1, "b" * 90), (None, "c")], "doc_id long, text string")
    assert digest.fingerprints_with_edits(same).count() == 4


def test_entropy_bins():
    x = np.random.default_rng(1).integers(97, 107, 500).astype(np.uint8)
    got = digest.entropy_bins(x)
    for i in range(0, len(got), 17):
        p = np.bincount(x[i : i + 64])
        p = p[p > 0] / 64
        assert abs(-(p * np.log2(p)).sum() / 6 * 1024 - got[i]) <= 1.01


def test_pages(spark):
    page = "<html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body><nav><ul><li><a href='/a'>Menu</a></li><li><a href='/b'>More</a></li></ul></nav><div class='ad'>Buy it now, friends.</div><article><h1>Head &amp; more</h1><p><b>First\n one.<br><p>Second &lt;two&gt; of them, with <i>in</i>line.</p></article><section class='comments'><p>I like it, really.</p></section><form><label>Name</label><input></form><footer>&copy; foot, all rights.</footer>"
    rows = spark.createDataFrame(
        [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p"), (5, "x", "<div>" * 3000 + "deep" + "<a " * 500)],
        "page_id long, url string, html string"
    ).withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(rows).collect()}
    assert got[1].text == "Head & more First one. Second <two> of them, with inline." and got[1].n_chars == len(got[1].text) and got[1].url == "u"
    assert got[2].text == "" and got[3].text == "" and got[2].url is None
    assert html.extract(rows.where("false")).count() == 0


def test_page_model_on_unseen_pages():
    pages = html.labelled(60, seed=77)
    p = html.default_model().marginals(pages)
    y = np.array([v for q in pages for v in q.label])
    texts = np.array([t is not None and t.strip() != "" for q in pages for t in q.text])
    assert ((p > 0.5) == y)[texts].mean() > 0.97


SENTENCES = [
    "The bridge was built in 1890, and it crosses the river near the mill.", "Later it was closed; nobody knows why, but many people asked.",
    "Two engineers, who had studied abroad, drew the first plans.", "Hardly anyone came.", "Its arches are of stone, its railings of iron.",
    "When the flood came, in the spring of 1911, the water rose to the third step of the toll house.", "What did it cost? Less than the town had feared.",
    "Today a path for walkers leads across it, and boats pass below."
]
NAV = "<nav><a href='/'>Home</a> <a href='/n'>News</a> <a href='/c'>Contact</a></nav>"
FOOT = "<footer>&copy; The Town Paper. All rights reserved.</footer>"
# how a page holds its title and paragraphs, without a container that says so, and with others
LAYOUTS = {
    "bare body": lambda t, ps: f"<body><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</body>",
    "body with surroundings": lambda t, ps: f"<body>{NAV}<h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"{FOOT}</body>",
    "bare div": lambda t, ps: f"<body>{NAV}<div><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</div>{FOOT}</body>",
    "table": lambda t, ps: f"<body><table><tr><td><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</td></tr></table></body>",
    "table with links": lambda t, ps: "<body><table><tr><td><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></td>" f"<td><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</td></tr></table></body>",
    "line breaks": lambda t, ps: f"<body>{NAV}<h1>{t}</h1>" + "<br><br>".join(ps) + f"{FOOT}</body>",
    "no end tags": lambda t, ps: f"<h1>{t}</h1>" + "".join(f"<p>{p}" for p in ps),
    "header in article": lambda t, ps: f"<body>{NAV}<article><header><h1>{t}</h1></header>" + "".join(f"<p>{p}</p>" for p in ps) + f"</article>{FOOT}</body>",
    "many links": lambda t, ps: f"<body>{NAV}<article><h1>{t}</h1>" + "".join("<p>" + " ".join(f"<a href='/{i}'>{w}</a>" if i % 4 == 0 else w for i, w in enumerate(p.split())) + "</p>" for p in ps) + f"</article>{FOOT}</body>",
    "named div, comments": lambda t, ps: f"<body>{NAV}<div class='content'><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</div><div class='comments'><h3>Comments</h3><div class='comment'><b>Ann</b> <p>I walked there once, it is lovely.</p></div></div>{FOOT}</body>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts_give_their_whole_text(layout):
    r = random.Random(layout)
    for n in (1, 2, 3, 5, 8):
        title, paragraphs = r.choice(["Bridge", "A bridge and its town"]), [" ".join(r.sample(SENTENCES, r.randint(2, 5))) for _ in range(n)]
        page = html.parse(LAYOUTS[layout](title, paragraphs))
        assert html.main_text(page, html.default_model().marginals([page])) == " ".join([title, *paragraphs])


@pytest.mark.parametrize("source, text", [
    ("just text", "just text"), ("<p>a<p>b<div>c", "a b c"), (f"<body>{NAV}<article><p>Hi.</p></article>{FOOT}</body>", "Hi."),
    (f"<body>{NAV}<article><p>See <a href='x'>this link</a>.</p><ul><li><a href='1'>One thing</a></li><li><a href='2'>Two things</a></li></ul></article></body>", "See this link. One thing Two things"),
    (f"<body>{NAV}{FOOT}</body>", ""),
])
def test_short_pages(source, text):
    page = html.parse(source)
    assert html.main_text(page, html.default_model().marginals([page])) == text


def test_deep_pages_are_linear():
    import time

    began = time.process_time()
    page = html.parse("<div>" * 40_000 + "deep" + "<li>a</b>" * 5000)
    html.default_model().marginals([page])
    assert time.process_time() - began < 20
    marks = [html.TAGS[t] if t < len(html.TAGS) else "?" for t in html.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>x<table><tr><td><p>y<div>z").tag]
    assert marks == "html ul li #text ul li #text li #text li #text p #text table tr td p #text div #text".split()


def test_messages_equal_enumeration():
    page = html.parse("<div><p>a</p><p>b<b>c</b></p></div>")
    f = html.forest([page])
    r = np.random.default_rng(1)
    n = len(f.parent)
    unary, pair = r.normal(size=(n, 2)), r.normal(size=(html.KINDS, 2, 2))
    p, edges, log_z = html.messages(f, unary, pair)
    total, one = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        one += w * np.array(y)
    assert np.allclose(p[:, 1], one / total) and np.isclose(log_z[0], np.log(total))


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("aeioumnr") for _ in range(r.randint(2, 8))) for _ in range(80)).capitalize() + "."
    bad = lambda: r.choice(
        [
            lambda: good().upper().replace(" ", "!! "), lambda: " ".join([w + "&&&" for w in good().split()]),
            lambda: " ".join(w for w in good().split()[:6] for _ in range(15))
        ]
    )()
    docs = [(i, good() if i % 4 else bad()) for i in range(900)]
    rows = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(900)] + [(None, 1), (3, None)], "doc_id long, quality int")
    net = quality.train(rows, labels)
    got = quality.score(rows, net).toPandas()
    held = got[got.held_out & (got.doc_id < 900)]
    assert len(got) == 902 and got.score.between(0, 1).all()
    assert ((held.predicted == 1) == (held.doc_id % 4 > 0)).mean() > 0.95
    kept = quality.keep(rows, net)
    assert kept.columns == rows.columns and kept.count() == (got.score >= 0.5).sum()
    nothing = quality.train(rows, labels.where("false"))
    assert quality.score(rows.limit(3), nothing).select("score").distinct().count() == 1
    assert quality.score(rows.where("false"), net).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 40))
    x[100:160] = x[100]  # one common vector: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (2000, None), (2020, [0.0] * 40), (2040, [float("nan")] * 40), (2060, [None] * 40), (2080, [1.0, 2.0]), (None, [1.0] * 40)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "dim": F.lit("clash")})
    got = ann.nearest(df, block_bytes=200 * 40 * 8).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 900, 20):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, score[mine.vec_id], rtol=1e-12)
        hits += len(set(best) & set(mine.vec_id))
    assert hits / (45 * 20) >= 0.98 and set(got.query_id) == set(range(0, 900, 20)) | {2080} - {2080}
    few = ann.nearest(df.where("vec_id <= 3")).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3] and sorted(few["rank"]) == [1, 2, 3]
    assert ann.nearest(df.where("false")).count() == 0


def test_chat_renders_true_prefixes(spark):
    turns = [("user", f"t{i}") for i in range(70)]
    preamble = lambda ts: "<s>" + "".join(f"[{t}]" for _, t in ts)
    assert "".join(chat.spans(turns, preamble)) == preamble(turns)
    keeps_last = lambda ts: "".join(f"[{t}]" for _, t in ts[-32:])
    alters = lambda ts: "".join(f"[{t}]" for _, t in ([("user", "changed")] if len(ts) >= 50 else ts[:1]) + ts[1:])
    for template in (keeps_last, alters):
        with pytest.raises(chat.RewritesHistory):
            list(chat.spans(turns, template))
    late = lambda ts: chat.instruct(ts[-32:])
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    few = spark.createDataFrame([(2, i, r, t) for i, (r, t) in enumerate(turns[:20])], rows.schema)
    marked = {r.conv_id: r for r in chat.format_conversations(rows.union(few), late).collect()}
    assert "turn 32" in marked[1].fault and marked[1].turns_sha256 is None and marked[1].n_turns == 70
    assert marked[2].fault is None and marked[2] == chat.format_conversations(few).first()
    pieces = chat.formatted(rows.union(few), late).collect()
    assert {(r.conv_id, r.piece is None, r.fault is None) for r in pieces} == {(1, True, False), (2, False, True)}
    other = lambda ts: "<bos>" + "".join(f"{r}: {t}\n" for r, t in ts)
    talk = [("assistant", "\nuser: x"), ("user", "b"), ("assistant", "")]
    pieces = list(chat.spans(talk, other))
    assert [x[s:e] for x, (s, e) in zip(pieces, chat.loss_spans(talk, pieces, other), strict=True)] == ["\nuser: x", "", ""]
    once = lambda ts: "<bos>" + chat.instruct(ts)
    assert "".join(chat.spans(turns * 3, once)) == once(turns * 3)
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns * 2, lambda ts: chat.instruct(ts[-20:])))
    assert "".join(r.piece for r in chat.formatted(rows).orderBy("turn").collect()) == chat.instruct(turns)


def test_nearest_with_repeated_ids_and_extreme_lengths(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 24))
    x[:100] *= 10.0 ** r.uniform(-150, 150, 100)[:, None]
    x[100:110] *= 1e-200
    x[110:120] *= 1e200
    ids = np.arange(300)
    ids[200:240] = 20  # one id in many rows
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(300, x[5].tolist())] * 30
    ids, x = np.append(ids, [300] * 30), np.concatenate([x, np.repeat(x[5:6], 30, axis=0)])
    for block_bytes in (1 << 20, 60 * 24 * 8):
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block_bytes=block_bytes).toPandas()
        assert set(got.query_id) == {i for i in ids.tolist() if i % 20 == 0} and not (got.query_id == got.vec_id).any()
        hits = total = 0
        for q in sorted(set(got.query_id)):
            with np.errstate(over="ignore", invalid="ignore"):
                asked = min(x[ids == q].tolist())
                score = (x * np.array(asked)[None]).sum(1)
            score[ids == q] = -np.inf
            others = np.flatnonzero(ids != q)
            want = np.lexsort((ids[others], -score[others]))[:20]
            mine = got[got.query_id == q].sort_values("rank")
            assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21))
            left = collections.Counter(ids[others][want].tolist())
            hits += sum((left & collections.Counter(mine.vec_id.tolist())).values())
            total += 20
        assert hits / total >= 0.98
    alone = spark.createDataFrame([(0, [1.0, 2.0])] * 21 + [(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(alone).collect()] == [(0, 1, 1.0)]
