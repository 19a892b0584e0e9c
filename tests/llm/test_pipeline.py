import collections
import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from talentweave.llm import bpe, mixing

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _inputs(spark, path):
    passage = " ".join(f"passage{i}" for i in range(60))
    rows, draw = [], random.Random(6)
    for i in range(240):
        text = " ".join(f"w{draw.randint(0, 996)}" for _ in range(80)) + "."
        if i % 6 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i in (7, 9):
            text = text + " " + passage
        if i == 11:
            text = rows[10][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(240, None, None, None, None), (241, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    _inputs(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        held[name] = docs
    for name in ("quality", "near duplicates", "repeats", "mix"):
        assert held[name].columns == list(corpus_pipeline.COLUMNS)
    clean = {i for i in range(240) if i % 6}
    kept = {r.doc_id for r in held["quality"].collect()}
    assert len(clean - kept) <= 6 and len(kept & {i for i in range(0, 240, 6)}) <= 2
    unique = {r.doc_id for r in held["near duplicates"].collect()}
    assert 10 in unique and 11 not in unique
    texts = {r.doc_id: r for r in held["repeats"].collect()}
    assert "passage30" not in texts[7].text and "w" in texts[7].text and texts[7].n_chars == len(texts[7].text)
    words = sum(len(r.text.split()) for r in held["repeats"].collect())
    mixed = sum(len(r.text.split()) for r in held["mix"].collect())
    assert abs(mixed - 1.5 * words) <= 3 * 81
    assert held["encode"].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and held["encode"].count() == held["mix"].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _brute_near(rows):
    """One row of each group of texts linked by a Jaccard similarity of at least 0.8 of their five-word shingles."""
    words = [(t or "").encode().translate(LOWER).split() for _, t, *_ in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    linked = [[a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    left, kept = set(range(len(rows))), []
    while left:
        group, new = set(), {min(left)}
        while new:
            group |= new
            new = {j for i in new for j in left if linked[i][j]} - group
        left -= group
        kept.append(min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)))
    return {(rows[i][0], rows[i][1]) for i in kept}


def _brute_cut(rows, window=35):
    split = [(t or "").split() for _, t, *_ in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, text, *_), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        new = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
        if (new or "").strip(" "):
            out.append((d, new))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**5)}"
    base = [[word() for _ in range(r.choice([3, 50, 90]))] for _ in range(70)]
    passage = [word() for _ in range(60)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join([*w[:20], word(), *w[21:]]) for w in base[:20]] + [" ".join([*w, *passage]) for w in base[20:26] if len(w) > 3]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(texts)]
    rows += [rows[5]] * 3 + [
        (None, texts[6], "en", "s1", 9), (None, "alone " + texts[7][::-1], "en", "s1", 9)
    ] + [(None, "twice but no id " * 9, None, None, None)] * 2 + [(900, None, None, "s1", None), (901, " ", "en", "s2", 1)]
    kept = [tuple(x) for x in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path)).collect()]
    assert len(kept) == len(_brute_near(rows)) and {(d, t) for d, t, *_ in kept} == _brute_near(rows)
    cut = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(kept, SCHEMA).repartition(3), str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.text) for x in cut), key=str) == sorted(_brute_cut(kept), key=str) and all(x.n_chars == len(x.text) for x in cut)
    assert any(x.doc_id == 5 for x in cut) and any(x.text.startswith("twice") for x in cut)  # one copy of what was repeated survives
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(cut, SCHEMA).repartition(3), str(tmp_path)).collect()
    times, words = collections.Counter(map(tuple, mixed)), collections.Counter()
    for x in cut:
        words[x.source] += len(x.text.split())
        assert times[tuple(x)] <= 2
    level = mixing.shares(dict(words))
    for s, n in words.items():
        taken = sum(len(x.text.split()) for x in mixed if x.source == s)
        assert abs(taken - level[s]) <= max(len(x.text.split()) for x in cut if x.source == s)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={}
    )
    ids = lambda t: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    got = corpus_pipeline.encode(spark, spark.createDataFrame(mixed, SCHEMA), str(tmp_path)).collect()
    want = [(x.doc_id, len(library.encode_ordinary(x.text)), ids(x.text), hashlib.sha256(x.text.encode()).hexdigest()) for x in mixed]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_what_comes(spark, tmp_path, stage):
    """Empty tables, nulls in all columns, repeated rows, and columns of the names that the operators use."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [
        (1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text, None, None, None), (2, None, None, None, None),
        (2, None, None, None, None), (3, "", "", "", 0), (4, "short", "en", "b", 5), (None, "no id", None, "b", 5),
        (None, "no id", None, "b", 5)
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("fp", "node", "k1", "component", "marks", "mix_size", "mix_hash", "name", "x_lang", "score", "n_tokens", "place")}
    ).repartition(3)
    spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    few = stage(spark, docs, str(tmp_path)).collect()
    none = stage(spark, docs.where("false"), str(tmp_path))
    assert none.count() == 0
    expected = {corpus_pipeline.keep_quality: 9, corpus_pipeline.drop_near_duplicates: 4, corpus_pipeline.cut_repeats: 3, corpus_pipeline.encode: 9}
    if stage in expected:
        assert len(few) == expected[stage]
    else:
        assert all((x.text or "").strip() for x in few)
    assert none.columns == (
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if stage is corpus_pipeline.encode else list(corpus_pipeline.COLUMNS)
    )


def test_entry_without_this_subpackage(tmp_path):
    code = "import sys; sys.modules['talentweave.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
