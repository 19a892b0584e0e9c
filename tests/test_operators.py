import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talentweave.operators import annotate, boards, dedupe, extract, filters, listings, matching, normalize, profiles, reports, state, sync, terms

NOW, LATER = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2)
POSTING = "source_id long, external_id string, id long, title string, url string, canonical_url string, content_hash string, embedding array<double>, active boolean, first_seen_at timestamp, last_seen_at timestamp, last_updated_at timestamp, application_status string, application_confirmation_needed boolean"


def _batch(spark, rows):
    return spark.createDataFrame(rows, "source_id long, external_id string, title string, url string, content_hash string")


def test_publish_twice_is_unchanged(spark):
    empty = spark.createDataFrame([], POSTING)
    batch = _batch(spark, [(1, "a", "A", "u1", "h1"), (1, "b", "B", "u2", "h2"), (1, "b", "B again", "u2", "h2")])
    first = sync.publish(empty, batch, NOW)
    assert {r.external_id: r.active for r in first.collect()} == {"a": True, "b": True}
    counts = {r.action for r in sync.compare(first, batch).collect()}
    assert counts == {"unchanged"}
    again = {r.external_id: r for r in sync.publish(first, batch, LATER).collect()}
    assert again["a"].first_seen_at == NOW and again["a"].last_seen_at == LATER and again["a"].last_updated_at == NOW


def test_publish_updates_and_deactivates(spark):
    stored = sync.publish(
        spark.createDataFrame([], POSTING),
        _batch(spark, [(1, "a", "A", "u", "h"), (1, "b", "B", "u", "h"), (2, "c", "C", "u", "h")]), NOW
    )
    stored = stored.withColumns({"embedding": F.array(F.lit(1.0)), "application_status": F.lit("applied")})
    new = _batch(spark, [(1, "a", "A2", "u", "h9")])
    full = {r.external_id: r for r in sync.publish(stored, new, LATER).collect()}
    assert full["a"].title == "A2" and full["a"].embedding is None and full["a"].application_status == "applied" and full["a"].last_updated_at == LATER
    assert not full["b"].active and full["c"].active
    kept = {r.external_id: r.active for r in sync.publish(stored, new, LATER, deactivate_missing=False).collect()}
    assert kept == {"a": True, "b": True, "c": True}
    moved = {r.external_id: r for r in sync.publish(stored, _batch(spark, [(1, "a", "A", "u-new", "h")]), LATER).collect()}
    assert moved["a"].url == "u-new" and moved["a"].last_updated_at == LATER and moved["a"].embedding == [1.0]


def test_source_upkeep(spark):
    sources = spark.createDataFrame([(1, "A", None, "old"), (2, "B", NOW, "ok")], "id long, name string, last_scan_at timestamp, last_status string")
    done = spark.createDataFrame([(1, LATER, None)], "source_id long, last_scan_at timestamp, last_status string")
    got = {r.id: r for r in sync.scan_state(sources, done).collect()}
    assert got[1].last_scan_at == LATER and got[1].last_status == "old" and got[2].last_scan_at == NOW
    assert [r.id for r in filters.due_sources(sources, 60, NOW + dt.timedelta(minutes=30)).collect()] == [1]
    assert [r.id for r in filters.due_sources(sources, 60, LATER).orderBy("id").collect()] == [1, 2]
    changed = sync.upsert(sources, spark.createDataFrame([(2, "B2"), (3, "C")], "id long, name string"))
    assert {r.id: (r.name, r.last_status) for r in changed.collect()} == {1: ("A", "old"), 2: ("B2", "ok"), 3: ("C", None)}
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id long, source_id long")
    assert [r.id for r in sync.without_sources(rows, sources.where("id = 1")).collect()] == [2]
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.7])], "id long, embedding array<double>")
    held = spark.createDataFrame([(1, [0.1], "m"), (2, None, None)], "id long, embedding array<double>, model string")
    assert {r.id: r.embedding for r in sync.fill_vectors(held, vectors).collect()} == {1: [0.1], 2: [0.7]}
    assert {r.id: r.embedding for r in sync.fill_vectors(held, vectors, model="new").collect()} == {1: [0.5], 2: [0.7]}


def test_dedupe_keeps_furthest_and_richest(spark):
    rows = spark.createDataFrame(
        [
            (1, "T", "https://a.org/1?utm_a=1", "short", "not_applied", NOW),
            (2, "T", "https://a.org/1", "a longer text", "not_applied", NOW), (3, "T", "https://a.org/1/", "x", "applied", NOW),
            (4, "T", None, "y", None, NOW), (5, "t ", "", "yy", None, NOW)
        ],
        "id long, title string, url string, description string, application_status string, last_seen_at timestamp",
    ).withColumns(
        {
            "company": F.lit("C"), "location": F.lit("L"), "job_type": F.lit(None).cast("string"),
            "canonical_url": F.lit(None).cast("string"), "application_confirmation_needed": F.lit(None).cast("boolean"),
            "required_skills": F.lit(None).cast("array<string>"), "skills": F.lit(None).cast("array<string>"),
            "last_updated_at": F.col("last_seen_at"), "first_seen_at": F.col("last_seen_at")
        }
    )
    once = dedupe.dedupe_postings(rows)
    assert sorted(r.id for r in once.collect()) == [3, 5]
    assert sorted(r.id for r in dedupe.dedupe_postings(once.repartition(3)).collect()) == [3, 5]


def test_listing_rules(spark):
    rows = spark.createDataFrame(
        [(1, p, i, f"{p}-{i}", p > 1 or i == 0) for p in range(1, 5) for i in range(6)] + [(1, 2, 9, "1-0", True)],
        "source_id long, page int, pos int, external_id string, known boolean"
    )
    rows = listings.dedupe_source(rows)
    assert rows.count() == 24
    kept = listings.early_stop(rows, listings.page_counts(rows, F.col("known")))
    assert kept.agg(F.max("page"), F.count("*")).first()[:] == (3, 18)
    fetched = spark.createDataFrame([(1, p) for p in range(1, 7)], "source_id long, page int")
    assert listings.empty_stop(rows.where("page <> 3"), fetched, 9).agg(F.max("page")).first()[0] == 2
    assert listings.cap(rows, 5).count() == 5
    page = spark.createDataFrame(
        [
            (1, 1, 0, "r", "u", "T", "C"), (1, 1, 1, "r", "v", "T2", "C"), (1, 1, 2, None, "w", "T", "C"),
            (1, 1, 3, "", "w", "T", "C"), (1, 1, 4, None, None, "", "C")
        ],
        "source_id long, page int, pos int, raw_id string, url string, title string, company string"
    )
    assert sorted(r.pos for r in listings.dedupe_page(page).collect()) == [0, 2]
    details = spark.createDataFrame([("r", "", "new")], "raw_id string, title string, company string")
    assert listings.override(page.where("pos = 0"), details, ["raw_id"], ["title", "company"]).select("title", "company").first()[:] == ("T", "new")
    assert listings.first_company(page.withColumn("company", F.when(F.col("pos") > 1, "Z")), ["source_id"]).first()["company"] == "Z"


def test_events_fold_to_state(spark):
    def events(*actions):
        return [(1, NOW + dt.timedelta(minutes=i), i, a) for i, a in enumerate(actions)]

    def status(*actions):
        r = state.fold_events(spark.createDataFrame(events(*actions), "posting_id long, ts timestamp, seq long, action string")).collect()
        return (r[0].status, r[0].confirmation_needed, r[0].pending_since) if r else None

    assert status("opened") == ("pending", True, NOW)
    assert status("applied", "opened") == ("applied", False, None)
    assert status("opened", "Not-Applied", "opened")[:2] == ("pending", True)
    assert status("not_interested", "opened", "not applied")[:2] == ("not_interested", False)
    assert status("nonsense") is None
    assert status("pending") == ("pending", True, NOW)


def test_scoring_rules(spark, col):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    score = lambda req, pref, every, known, has=True: col(
        matching.skill_score(matching.weighted_skills(a(*req), a(*pref), a(*every)), a(*known), F.lit(has))
    )
    assert score(["x", "y"], [], [], ["x"]) == pytest.approx(0.5)
    assert score(["x"], ["y"], [], ["x"]) == pytest.approx(0.75 / 1.55 + 0.25)
    assert score([], [], ["x", "y"], ["y"]) == pytest.approx(0.5)
    assert score([], [], [], []) == 0.5 and score([], [], [], [], False) == 0.0
    years = lambda h, w: col(matching.experience_score(F.lit(h).cast("double"), F.lit(w).cast("double")))
    assert [years(2, 4), years(9, 4), years(0, 4), years(1, None), years(0, 0)] == [0.5, 1.0, 0.0, 1.0, 1.0]
    assert matching.normalized_weights({"embedding": 0, "skill": 0, "experience": 0}) == matching.WEIGHTS


def test_rank_matches_end_to_end(spark):
    none = F.lit(None)
    postings = spark.createDataFrame(
        [
            (1, "Python engineer", ["Python"], "build python services", 2.0), (2, "Welder", ["Welding"], "weld steel", 1.0),
            (3, "Python engineer", ["Python"], "build", 2.0)
        ], "id long, title string, required_skills array<string>, summary_text string, experience_years double"
    ).withColumns(
        {
            "company": F.lit("C"), "location": F.lit("Paris"), "description": F.col("summary_text"), "url": F.lit(""),
            "canonical_url": F.lit(""), "job_type": F.lit("full-time"), "remote_mode": F.lit("remote"),
            "clearance_terms": F.array(F.lit("Secret")), "preferred_skills": none.cast("array<string>"),
            "skills": none.cast("array<string>"), "salary_text": F.lit("$20 - $30 per hour"),
            "application_status": none.cast("string"), "application_confirmation_needed": F.lit(False), "active": F.lit(True),
            "source_id": F.lit(1), "last_seen_at": F.lit(NOW), "last_updated_at": F.lit(NOW), "first_seen_at": F.lit(NOW)
        }
    )
    people = spark.createDataFrame(
        [(10, "python services engineer", ["python"], 3.0, ["secret"])],
        "profile_id long, summary_text string, skills array<string>, experience_years double, clearance_terms array<string>"
    )
    got = matching.rank_matches(people, postings, active_only=True, location_query="PARIS").orderBy("rank").collect()
    assert [r.posting_id for r in got] == [1, 2]  # 3 is merged into 1
    assert got[0].matched_skills == ["Python"] and got[1].missing_skills == ["Welding"] and got[0].matched_clearance == ["Secret"]
    assert all(0 <= r.score <= 1 for r in got) and len(got[0].reasons) == 7
    assert matching.rank_matches(people, postings, job_type="contract").count() == 0
    assert [r.id for r in reports.unmatched(postings.select("id"), matching.rank_matches(people, postings)).collect()] == [3]
    assert matching.browse_postings(postings, clearance_terms=["SECRET"]).count() == 2


RESUME = """Jane Doe
jane@x.org | 555-123-4567
Denver, CO
SUMMARY
Engineer with an active Secret clearance.
Experience:
Platform Engineer | Acme | Jan 2020 - Dec 2021
- Built pipelines
- Ran clusters
Analyst at Beta Corp | Jun 2019 - Jan 2020
Page 2 of 3
EDUCATION
Bachelor of Science 2010 - 2014
State University
Honors
Skills
Python, Azure
"""


def test_profile_structure(spark):
    texts = spark.createDataFrame([(1, RESUME), (2, "short"), (3, None)], "resume_id long, text string")
    got = profiles.structure(
        texts, {"Python": ["python"], "Azure": ["azure"]}, {"Python": "language", "Azure": "cloud"}, {"CISSP": ["cissp"]},
        dt.date(2024, 1, 1)
    ).collect()
    assert [r.resume_id for r in got] == [1]
    r = got[0]
    assert r.titles == ["Platform Engineer", "Analyst"] and r.skills == ["Azure", "Python"] and r.tools == ["Azure"] and r.clearance_terms == ["Secret"]
    assert r.full_name == "Jane Doe" and r.email == "jane@x.org" and r.location == "Denver, CO"
    assert set(r.sections) == {"summary", "experience", "education", "skills"}
    assert r.experience_years == pytest.approx(round((24 + 7 + 49) / 12, 1), abs=0.1)
    assert "Recent titles: Platform Engineer, Analyst" in r.summary_text


def test_history_and_education(spark):
    rows = profiles.sectioned(profiles.lines(spark.createDataFrame([(1, RESUME)], "resume_id long, text string")))
    work = profiles.work_history(rows.where("section = 'experience'"), dt.date(2024, 1, 1)).orderBy("n").collect()
    assert [(w.title, w.start_date.isoformat(), w.is_current) for w in work] == [
        ("Platform Engineer", "2020-01-01", False), ("Analyst", "2019-06-01", False)
    ]
    assert work[0].description == "Built pipelines Ran clusters"
    school = profiles.education(rows.where("section = 'education'"), dt.date(2024, 1, 1)).collect()
    assert [(e.school, e.degree, e.description) for e in school] == [("State University", "Bachelor of Science", "Honors")]
    plain = profiles.education(
        spark.createDataFrame([(1, 1, "Some School"), (1, 2, "Other")], "resume_id long, pos int, line string"),
        dt.date(2024, 1, 1)
    ).orderBy("n").collect()
    assert [e.school for e in plain] == ["Some School", "Other"]


def test_normalize_and_enrich(spark):
    sources = spark.createDataFrame([(1, "Acme", "https://acme.org/jobs", "custom_url")], "id long, name string, url string, source_type string")
    rows = spark.createDataFrame(
        [
            (
                1, "a", "Engineer",
                "Remote role. Requirements: Python and 5+ years of experience. Preferred: Azure. Pay: $100,000 - $120,000 per year. Active Secret clearance.",
                None
            ),
            (1, "b", "", "x", None), (1, "c", "Clerk", "office", "Contract")
        ],
        "source_id long, raw_id string, title string, description string, salary_text string",
    )
    skills = {"Python": ["python"], "Azure": ["azure"], "Go": ["go"]}
    got = {r.external_id: r for r in normalize.normalize_postings(rows, sources, skills).collect()}
    assert set(got) == {"a", "c"} and normalize.split_valid(rows)[1].first()["reason"] == "missing title"
    a = got["a"]
    assert (
        a.remote_mode, a.salary_text, a.salary_interval, a.experience_years, a.company
    ) == ("remote", "$100,000 - $120,000/yr", "year", 5.0, "Acme")
    assert a.preferred_skills == ["Azure"] and "Python" in a.required_skills and a.clearance_terms == ["Secret"] and a.canonical_url == "https://acme.org/jobs"
    assert got["c"].employment_text == "Contract" and got["c"].job_type == "contract" and got["c"].salary_text is None
    replies = spark.createDataFrame(
        [(1, "c", 'Sure: {"required_skills": ["Go"], "salary_text": "$20 per hour", "experience_years_hint": 2}'), (1, "a", "no")],
        "source_id long, external_id string, reply string"
    )
    parsed = normalize.parse_replies(replies)
    assert [r.external_id for r in parsed.collect()] == ["c"]
    more = {r.external_id: r for r in normalize.normalize_postings(rows, sources, skills, parsed).collect()}
    assert more["c"].required_skills == ["Go"] and more["c"].experience_years == 2.0 and more["c"].salary_text is not None
    assert more["a"].content_hash == a.content_hash and more["c"].content_hash != got["c"].content_hash
    numbered = spark.createDataFrame([(i, 1, "d" * 130) for i in range(5)], "id long, source_id long, description string")
    assert normalize.to_enrich(numbered, 3).count() == 3 and normalize.to_enrich(numbered, 0).count() == 5


PAGE = """<html><head><link rel="next" href="/jobs?page=2"><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Cook", "identifier": {"value": "77"}, "url": "/c",
"hiringOrganization": {"name": "Diner"}, "jobLocation": {"address": {"addressLocality": "Oslo", "addressCountry": "NO"}}, "baseSalary": {"currency": "USD", "value": {"minValue": 10, "maxValue": 12, "unitText": "HOUR"}}}, {"@type": "Person"}]}</script>
<script type="application/ld+json">{broken</script></head><body><a href="https://boards.greenhouse.io/acme/jobs/1">Acme jobs</a><a href='/careers'>Careers</a>
<div class="card big" data-id="1"><h2>First &amp; best</h2><span class="co">A</span></div><div class="card"><h2>Second</h2><p><i>B</i></p></div></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame(
        [(1, "https://x.org/jobs", PAGE, "list"), (2, "https://x.org/none", None, "list")],
        "page_id long, url string, html string, layout string"
    )
    assert [(r.url, r.text) for r in extract.extract_links(pages).orderBy("pos").collect()] == [
        ("https://boards.greenhouse.io/acme/jobs/1", "Acme jobs"), ("https://x.org/careers", "Careers")
    ]
    assert [(r.page_id, r.next_url) for r in extract.next_page(pages).collect()] == [(1, "https://x.org/jobs?page=2")]
    job = extract.jsonld_postings(pages).collect()
    assert [
        (j.raw_id, j.title, j.company, j.location, j.salary_text, j.url) for j in job
    ] == [("77", "Cook", "Diner", "Oslo, NO", "$10 - $12/hr", "https://x.org/c")]
    layout = spark.createDataFrame(
        [
            ("list", "card", "container", 0, "div.card"), ("list", "card", "title", 0, "h2"),
            ("list", "card", "company", 0, "span.co"), ("list", "card", "company", 1, "p"),
            ("list", "card", "key", 0, "@data-id"), ("list", "detail", "title", 0, "h2")
        ],
        "layout string, scope string, field string, ord int, selector string"
    )
    cards = extract.extract_layout(pages, layout, "card").orderBy("pos").collect()
    assert [(c.title, c.company, c["key"]) for c in cards] == [("First & best", "A", "1"), ("Second", "B", "")]
    assert [d.title for d in extract.extract_layout(pages.where("page_id = 1"), layout, "detail").collect()] == ["First & best"]


def test_discovery_follows_career_pages(spark):
    html = lambda *links: "".join(f"<a href='{u}'>{t}</a>" for u, t in links)
    pages = spark.createDataFrame(
        [
            (1, "https://a.org/", html(("/careers", "Careers"), ("https://linkedin.com/x", "in"))),
            (2, "https://a.org/careers", html(("https://jobs.lever.co/acme/1", "x"), ("https://jobs.lever.co/acme/2", "y"))),
            (3, "https://b.org/jobs", html(("/about", "About")))
        ],
        "page_id long, url string, html string",
    )
    seeds = spark.createDataFrame([("acme", "https://a.org/"), ("b", "https://b.org/jobs")], "query string, url string")
    got = {(r["query"], r.board_url, r.platform) for r in extract.discover(pages, seeds).collect()}
    assert got == {("acme", "https://jobs.lever.co/acme", "lever"), ("b", "https://b.org/jobs", "careers page")}
    assert extract.discover(pages, seeds, max_depth=0).count() == 1


def test_only_rows_without_vectors_are_encoded(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def encoder(texts: pd.Series) -> np.ndarray:
        with open(seen, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return np.array([[float(len(t)), 1.0] for t in texts])

    rows = spark.createDataFrame(
        [(1, "a", [9.0, 9.0]), (2, "bb", None), (3, None, None), (4, "dddd", [1.0, 1.0])],
        "id long, summary_text string, embedding array<double>"
    ).coalesce(1)
    got = {r.id: r.embedding for r in matching.encode(rows, encoder=encoder).collect()}
    assert got == {1: [9.0, 9.0], 2: [2.0, 1.0], 3: [0.0, 1.0], 4: [1.0, 1.0]}
    assert sorted(open(seen).read().split("\n")[:-1]) == ["", "bb"]
    assert {r.id: r.embedding for r in matching.encode(rows.drop("embedding").limit(2), encoder=encoder).collect()} == {1: [1.0, 1.0], 2: [2.0, 1.0]}


CASES = [
    ("Straße", ["Road"]), ("strasse!", ["Road"]), ("use asp.net", []), ("use .NET", ["Dot"]), ("c++x", []),
    ("C++ and x", ["Cpp"]), ("big  data", ["Big"]), ("bigdata big-data", []), ("", []), (None, []), ("#c++#", ["Cpp"]),
    ("c#, .net", ["Dot", "Sharp"])
]
ALIASES = [("Road", "straße"), ("Dot", ".net"), ("Cpp", "c++"), ("Big", "Big   Data"), ("Sharp", "C#"), ("Empty", "  ")]


def test_small_and_large_lexicons_agree(spark, monkeypatch):
    lexicon = spark.createDataFrame([(c, a, "x", i) for i, (c, a) in enumerate(ALIASES)], "canonical string, alias string, category string, ord int")
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string")
    for most in (200, 0):
        monkeypatch.setattr(terms, "INLINE_ALIASES", most)
        got = {r.id: r.terms for r in terms.annotate_terms(rows, "text", lexicon).collect()}
        assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_best_matches_equal_all_pairs(spark):
    r = random.Random(4)
    names = [f"s{i}" for i in range(12)]
    pick = lambda n: [r.choice(names).upper() if r.random() < 0.3 else r.choice(names) for _ in range(r.randint(0, n))]
    vector = lambda: None if r.random() < 0.1 else [0.0] * 5 if r.random() < 0.1 else [r.gauss(0, 1) for _ in range(5)]
    jobs = [(i, vector(), pick(3), pick(3), pick(4) or None, r.choice([None, 0.0, 1.0, 4.0]), r.choice([None, 3, 4])) for i in range(300)]
    jobs += [(300 + i, *jobs[7][1:]) for i in range(200)]  # very many copies of one posting
    postings = spark.createDataFrame(
        jobs,
        "id long, embedding array<double>, required_skills array<string>, preferred_skills array<string>, skills array<string>, experience_years double, last_seen_at int"
    ).repartition(3)
    people = spark.createDataFrame(
        [(f"p{i}", vector(), pick(6) or None, r.choice([None, 0.0, 2.0])) for i in range(30)],
        "profile_id string, embedding array<double>, skills array<string>, experience_years double"
    )
    known = spark.createDataFrame([(a, b) for a in names for b in names if a[-1] == b[-1]], "left string, right string")
    for pairs in (None, known):
        want = matching.top_k(matching.score_pairs(people, postings, pairs), 7).select("p_profile_id", "id", "rank", "score").collect()
        got = matching.best_matches(people, postings, 7, pairs).select("p_profile_id", "id", "rank", "score").collect()
        assert sorted(got) == sorted(want) and len(got) == 210
    assert matching.best_matches(people, postings.where("false"), 7).count() == 0 and matching.best_matches(people.where("false"), postings, 7).count() == 0


def test_reasons_tell_only_what_is_known(spark):
    a = F.array().cast("array<string>")
    rows = spark.range(1).withColumns(
        {
            "embedding_score": F.lit(0.5), "skill_score": F.lit(0.0), "experience_score": F.lit(1.0), "matched_skills": a,
            "missing_skills": a, "required_skills": a, "matched_clearance": a, "clearance_terms": a,
            "salary_text": F.lit("Full-time")
        }
    )
    assert len(rows.select(matching.reasons().alias("r")).first().r) == 3
    more = rows.withColumns({"required_skills": F.array(F.lit("x")), "salary_text": F.lit("pay $20 to $30 per hour")})
    assert more.select(matching.reasons().alias("r")).first().r[3:] == ["No skill gap.", "Pay: $20 - $30/hr."]


def test_salary_of_long_texts_is_linear(spark):
    text = " | ".join(f"Part {i} pays ${i} - ${i + 5} per hour" for i in range(20, 25_000))
    rows = spark.createDataFrame([(text,), ("Pay: $10 - $20 per hour | Salary $30,000 - $40,000 a year | pay: $10 - $20 PER HOUR",)], "text string")
    got = [r.s for r in rows.select(annotate.salary(F.col("text")).alias("s")).collect()]
    assert got[0].interval == "hour" and got[1].low == 30_000


def test_scan_log_and_reset(spark):
    sources = spark.createDataFrame(
        [(1, "e"), (2, "f")], "id long, etag string"
    ).withColumns({"last_modified": F.lit("m"), "last_scan_at": F.lit(NOW), "last_status": F.lit("ok")})
    from talentweave.sources import sinks

    log = sinks.begin_scans(sources, NOW)
    assert [r.status for r in log.collect()] == ["running"] * 2 and log.select("id").distinct().count() == 2
    done = log.where("source_id = 2").select("id", F.lit("error").alias("status"), F.lit("why").alias("error_text"))
    got = {r.source_id: r for r in sinks.finish_scans(log, done, LATER).collect()}
    assert (
        got[1].status, got[1].finished_at, got[2].status, got[2].error_text, got[2].finished_at, got[2].jobs_found
    ) == ("running", None, "error", "why", LATER, 0)
    rows, scans, back = sync.cleared(sources, log, sources)
    assert rows.count() == scans.count() == 0 and back.select(
        "etag", "last_modified", "last_scan_at", "last_status"
    ).distinct().collect() == [(None, None, None, None)]


def test_words_of_cards_and_links(spark, col):
    assert [
        col(filters.bundled(F.lit(x))) for x in ("Multiple  Openings", "hiring multiple cooks", "see all", "oversee allied", "multiple positions")
    ] == [True, True, True, False, False]
    assert [
        col(filters.job_like(F.lit(h), F.lit("title"))) for h in ("/posting/1", "/opportunities", "/vacancies", "/Careers")
    ] == [True, True, False, True]
    assert col(annotate.clearance_token(F.lit("TS/SCI"))) and not col(annotate.clearance_token(F.lit("day shift")))


def test_walk_ends_where_pages_lead_back(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("b", "a"), ("x", "x")], "page_url string, to string")
    seeds = spark.createDataFrame([("q", "a"), ("r", "c"), ("r", "x"), ("s", None)], "query string, page_url string")
    got = {(r["query"], r.page_url): r.depth for r in extract.walk(seeds, steps, 3).collect()}
    assert got == {
        ("q", "a"): 0, ("q", "b"): 1, ("q", "c"): 2, ("q", "d"): 3, ("r", "c"): 0, ("r", "a"): 1, ("r", "d"): 1, ("r", "b"): 2, ("r", "e"): 2, ("r", "x"): 0, ("s", None): 0
    }
    assert {r.page_url for r in extract.walk(seeds, steps, 0).collect()} == {"a", "c", "x", None}


def test_selectors_by_places_and_by_scan():
    import random

    r = random.Random(9)
    tag = lambda: r.choice(["div", "p", "a", "li", "span"])
    extra = lambda: r.choice(["", " class='x'", " class='x y'", " id='one'", " href='/j'", " class='y' data-testid='t1'"])
    for _ in range(30):
        source = ""
        for _ in range(40):
            name = tag()
            source += f"<{name}{extra()}>t" + ("</div></p>" if r.random() < 0.3 else f"</{name}>" if r.random() < 0.6 else "")
        tree = extract._Tree(source)
        for selector in ("div", ".x", ".x.y", "#one", "a[href]", "div .y", "div > .x", "[data-testid='t1']", "p[data-testid*='t'], li.x", "div p > span", "[href='/j'].x", "b"):
            chains = extract._chains(selector)
            for top in (0, 3, len(tree.nodes) - 1):
                scanned = [i for i in range(top + 1, tree.end[top]) if any(tree._matches(i, c) for c in chains)]
                assert tree.find(selector, top) == scanned


def test_a_detail_page_is_parsed_once(spark):
    pages = spark.createDataFrame([(1, "https://x.example/1", "<h1>Cook</h1>", "generic")], "page_id long, url string, html string, layout string")
    rows = boards.details(pages)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1 and rows.first()["title"] == "Cook"
