from pyspark.sql import functions as F

from talentweave.operators import annotate as A
from talentweave.operators import terms

L = F.lit


def test_salary_range_beats_experience_range(col):
    s = col(A.salary(L("Requires 1-5 years of experience. | Pay: $35.00 - $45.50 per hour | full time")))
    assert (s.low, s.high, s.interval, s.display) == (35.0, 45.5, "hour", "$35 - $45.50/hr")


def test_salary_forms(col):
    assert col(A.salary(L("salary 120k to 150k per year"))).display == "$120,000 - $150,000/yr"
    assert col(A.salary(L("$50"))).display is None
    assert col(A.salary(L("Starting at $22.50 an hour"))).display == "$22.50/hr"
    assert col(A.salary(L(None).cast("string"))).display is None
    assert col(A.salary(L("5 - 3 usd pay"))).low is None or col(A.salary(L("5 - 3 usd pay"))).low <= col(A.salary(L("5 - 3 usd pay"))).high


def test_salary_rank_prefers_pay_lines(spark):
    rows = spark.createDataFrame([("$30 - $40 per hour",), ("Full-time contract, remote",), ("$30 per hour, contract",)], "t string")
    best = rows.agg(F.max_by("t", A.salary_rank(F.col("t"))).alias("t")).first()["t"]
    assert best == "$30 - $40 per hour"


def test_clearance(col):
    c = col(A.clearance(L("Must hold an active TS/SCI clearance with CI polygraph. We keep a secret sauce. Ability to obtain a Secret clearance is fine.")))
    assert c.terms == ["TS/SCI", "Secret", "CI Polygraph"] and c.active and c.obtainable
    assert c.summary == "TS/SCI Secret CI Polygraph (active/current, eligible to obtain)"
    assert col(A.clearance(L("The secret to success."))).terms == []
    assert col(A.clearance(L(None).cast("string"))).summary == ""


def test_labels(col):
    assert col(A.work_mode(L("Hybrid or remote"))) == "remote"
    assert col(A.work_mode(L(""))) == "unknown"
    assert col(A.job_type(L("Contractor, part-time"))) == "part-time"
    assert col(A.years_mentioned(L("3+ years of SQL, 5 years of Java"))) == 5.0
    assert col(A.years_mentioned(L("none"))) is None
    assert col(A.placeholder(L(" Not specified "))) and not col(A.placeholder(L("x")))
    assert col(A.challenge_page(L("Just a Moment...")))


LEXICON = [
    ("Azure", "azure", "cloud", 1), ("Azure AD", "azure active directory", "platform", 2), ("C++", "c++", "language", 3),
    ("Entra", "entra id", "platform", 4), ("Entra", "active directory", "platform", 5)
]
SCHEMA = "canonical string, alias string, category string, ord int"


def test_terms_small_medium_and_large_lexicon(spark, monkeypatch):
    lexicon = spark.createDataFrame([*LEXICON, ("Blank", " ", "x", 6), ("azure", "AZURE", "cloud", 7), ("Street", "Straße", "x", 8)], SCHEMA)
    rows = spark.createDataFrame([(1, "Azure Active\nDirectory and C++."), (2, "azured xc++"), (3, None), (4, "c++"), (5, ""), (6, "\U0001f600 strasse\U0001f600c++")], "id long, text string")

    def found():
        return {r.id: r.terms for r in terms.annotate_terms(rows, "text", lexicon).collect()}

    want = {1: ["Azure", "Azure AD", "C++", "Entra"], 2: [], 3: [], 4: ["C++"], 5: [], 6: ["C++", "Street"]}
    assert found() == want
    monkeypatch.setattr(terms, "INLINE_ALIASES", 2)
    assert found() == want
    monkeypatch.setattr(terms, "AUTOMATON_LETTERS", 2)
    assert found() == want


def test_terms_of_100_000_aliases_as_joined_and_without_an_exchange(spark, monkeypatch):
    many = spark.range(100_000).select(
        F.concat(F.lit("Term "), F.col("id") % 5000).alias("canonical"), F.concat(F.lit("t"), F.col("id") % 1000, F.lit("-x "), F.col("id")).alias("alias")
    )
    text = F.concat_ws(" ", *[F.concat(F.lit("T"), (F.col("id") * k) % 1000, F.lit("-X  "), (F.col("id") * k) % 3000 + 1000 * k + k % 2, F.lit(",")) for k in range(1, 9)])
    rows = spark.range(500).select("id", text.alias("text"))
    walked = terms.annotate_terms(rows, "text", many)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Generate" not in plan
    got = {r.id: r.terms for r in walked.collect()}
    monkeypatch.setattr(terms, "AUTOMATON_LETTERS", 0)
    assert got == {r.id: r.terms for r in terms.annotate_terms(rows, "text", many).collect()}
    assert sum(map(len, got.values())) > 100


def test_empty_lexicon(spark):
    rows = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert terms.annotate_terms(rows, "text", spark.createDataFrame([], SCHEMA)).collect()[0].terms == []


def test_skill_pairs(spark):
    lexicon = spark.createDataFrame(LEXICON, SCHEMA)
    left = spark.createDataFrame([("Active Directory",), ("c plus plus",), ("Python",), (None,)], "name string")
    right = spark.createDataFrame([("Entra ID",), ("C++",), ("python 3",), ("Go",), ("",)], "name string")
    got = {tuple(r) for r in terms.skill_pairs(left, right, lexicon).collect()}
    assert got == {("Active Directory", "Entra ID"), ("c plus plus", "C++"), ("Python", "python 3")}
