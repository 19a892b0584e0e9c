"""Annotations by fixed patterns: clearance, salary, work mode, job type, years of experience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.functions.text import fold, let, squeeze

# ---- fixed values: clearance -------------------------------------------------------------------------------
CLEARANCE_ORDER = ("TS/SCI", "Top Secret", "Secret", "Confidential", "Public Trust", "Full Scope Polygraph", "CI Polygraph", "Polygraph")
CLEARANCE_LEVELS = {
    "TS/SCI": r"\bts\s*\/\s*sci\b|\btop secret\s*\/\s*sci\b|\btop secret sensitive compartmented information\b",
    "Top Secret": r"\btop secret\b|\bts clearance\b|\bactive ts\b|\bcurrent ts\b",
    "Secret": r"\bsecret clearance\b|\bactive secret\b|\bcurrent secret\b|\bsecret level\b|\bsecret eligible\b|\beligible for secret\b|\bability to obtain (?:an? )?secret\b",
    "Confidential": r"\bconfidential clearance\b|\bconfidential level\b",
    "Public Trust": r"\bpublic trust\b|\bhigh public trust\b|\bmoderate public trust\b",
}
CLEARANCE_CONTEXT = r"\b(clearance|clearances|cleared|polygraph|poly|adjudicat|investigation|eligible|eligibility|obtain|maintain|maintained|access|sci|sap|dod|federal|public trust)\b"
CLEARANCE_ACTIVE = r"\b(active|current|existing|adjudicated|held|maintain(?:ed)?|possess(?:es|ed)?)\b"
CLEARANCE_OBTAIN = r"\b(eligible|eligibility|ability)\b.*\b(obtain|maintain)\b|\bmust be able to obtain\b"
POLYGRAPHS = (
    ("Full Scope Polygraph", r"\b(full[- ]scope|fs)\s+poly(graph)?\b"),
    ("CI Polygraph", r"\b(ci|counterintelligence)\s+poly(graph)?\b"), ("Polygraph", r"\bpoly(graph|graphed)?\b")
)
# ---- fixed values: work mode, job type ---------------------------------------------------------------------
WORK_MODES = {
    "remote": r"\bremote\b|\bwork from home\b|\bdistributed\b",
    "hybrid": r"\bhybrid\b|\bremote\/onsite\b",
    "on-site": r"\bon[- ]site\b|\bin office\b|\bon site\b",
}
JOB_TYPES = {
    "full-time": r"\bfull[- ]time\b",
    "part-time": r"\bpart[- ]time\b",
    "contract": r"\bcontract\b|\bcontractor\b|\b1099\b",
    "temporary": r"\btemporary\b|\btemp\b",
    "internship": r"\bintern(ship)?\b",
    "apprenticeship": r"\bapprenticeship\b",
}
YEARS = r"(?i)(\d+(?:\.\d+)?)\+?\s+years?"
# ---- fixed values: salary ----------------------------------------------------------------------------------
AMOUNT = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s*[km])?"
RANGE = rf"(?:\bbetween\b|\bfrom\b)?\s*(\$|usd)?\s*({AMOUNT})\s*(?:-|to|and|through|up to|–|—)\s*(\$|usd)?\s*({AMOUNT})([^.;,\n]{{0,48}})"
DASHED = rf"(?:\bbetween\b|\bfrom\b)?\s*(\$|usd)?\s*({AMOUNT})\s*(?:–|—)\s*(\$|usd)?\s*({AMOUNT})([^.;,\n]{{0,48}})"
NAMED = rf"\b(?:salary|compensation|pay range|pay|hourly rate)\b[^$0-9]{{0,20}}(\$|usd)?\s*({AMOUNT})([^.;,\n]{{0,40}})"
BOUNDED = rf"\b(?:starting at|starts at|from|up to|minimum of|maximum of)\b[^$0-9]{{0,12}}(\$|usd)?\s*({AMOUNT})([^.;,\n]{{0,40}})"
INTERVALS = {
    "hour": (r"\bper hour\b|\ban hour\b|\bhourly\b|\/hr\b|\bhr\b", "/hr"),
    "year": (r"\bper year\b|\byearly\b|\bannual(?:ly)?\b|\/yr\b|\ba year\b", "/yr"),
    "month": (r"\bper month\b|\bmonthly\b|\/mo\b", "/mo"),
    "week": (r"\bper week\b|\bweekly\b|\/wk\b", "/wk"),
    "day": (r"\bper day\b|\bdaily\b|\/day\b", "/day"),
}
PAY_CONTEXT = r"\b(salary|compensation|pay|rate|hourly|annual|base)\b"
PAY_CONTEXT_SINGLE = r"\b(salary|compensation|pay|rate|hourly|annual|base|starting at|starts at|minimum of|maximum of|up to)\b"
PAY_WORD = r"\bpay(?: range)?\b|\bsalary\b|\bcompensation\b"
OF_EXPERIENCE = r"\byears?(?:\s+of)?\s+experience\b"
YEARS_RANGE = r"\b\d+(?:\.\d+)?\s*(?:-|to|and|through)\s*\d+(?:\.\d+)?\s+years?\b"
BEFORE, AFTER = 24, 48


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def first_label(text: Column, patterns: dict[str, str], default: str | None) -> Column:
    """The first label whose pattern is found."""

    def body(folded: Column) -> Column:
        out = F.lit(default).cast("string")
        for label, pattern in reversed(list(patterns.items())):
            out = F.when(folded.rlike(pattern), label).otherwise(out)
        return out

    return let(fold(squeeze(text)), body)


def work_mode(text: Column) -> Column:
    return first_label(text, WORK_MODES, "unknown")


def job_type(text: Column) -> Column:
    return first_label(text, JOB_TYPES, None)


def years_mentioned(text: Column) -> Column:
    """The largest number of years mentioned, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEARS), 1), lambda x: x.try_cast("double")))


def _sentence_terms(s: Column) -> Column:
    found = []
    for name, pattern in CLEARANCE_LEVELS.items():
        hit = _has(s, pattern)
        if name == "Top Secret":
            hit = hit & ~_has(s, r"\bts\s*\/\s*sci\b")
        if name == "Secret":
            hit = hit & ~_has(s, r"\btop secret\b")
        found.append(F.when(hit, name))
    poly = F.lit(None).cast("string")
    for name, pattern in reversed(POLYGRAPHS):
        poly = F.when(_has(s, pattern), name).otherwise(poly)
    return F.array_compact(F.array(*found, poly))


def sentences(text: Column) -> Column:
    """White space squeezed first, so only sentence ends split."""
    return F.filter(F.split(squeeze(text), r"(?<=[.!?;])\s+"), lambda s: s != "")


def clearance(text: Column) -> Column:
    """struct(terms, summary, active, obtainable), from sentences that speak of clearance and name one."""
    speaks = lambda s: F.lower(s).contains("top secret") | F.lower(s).contains("ts/sci") | F.lower(s).contains("public trust") | _has(s, CLEARANCE_CONTEXT)
    told = F.filter(
        F.transform(F.filter(sentences(text), speaks), lambda s: F.struct(s.alias("s"), _sentence_terms(s).alias("t"))),
        lambda x: F.size(x["t"]) > 0
    )

    def body(told: Column) -> Column:
        named = F.flatten(F.transform(told, lambda x: x["t"]))
        terms = F.filter(F.array(*[F.lit(x) for x in CLEARANCE_ORDER]), lambda t: F.array_contains(named, t))
        return F.struct(
            terms.alias("terms"), F.exists(told, lambda x: _has(x["s"], CLEARANCE_ACTIVE)).alias("active"),
            F.exists(told, lambda x: _has(x["s"], CLEARANCE_OBTAIN)).alias("obtainable")
        )

    def summed(c: Column) -> Column:
        marks = F.concat_ws(", ", F.when(c["active"], "active/current"), F.when(c["obtainable"], "eligible to obtain"))
        summary = F.concat_ws(" ", c["terms"], F.when(c["active"] | c["obtainable"], F.concat(F.lit("("), marks, F.lit(")"))))
        return F.struct(c["terms"].alias("terms"), summary.alias("summary"), c["active"].alias("active"), c["obtainable"].alias("obtainable"))

    return let(let(told, body), summed)


def amount(c: Column) -> Column:
    """Number with thousands commas and k or m, to 2 places; null if it is none."""

    def body(text: Column) -> Column:
        times = F.when(text.endswith("k"), 1000.0).when(text.endswith("m"), 1_000_000.0).otherwise(1.0)
        return F.bround(F.regexp_replace(text, r"[,\skm]", "").try_cast("double") * times, 2)

    return let(F.lower(squeeze(c)), body)


def amount_text(c: Column) -> Column:
    return F.when(c >= 1000, F.format_number(F.bround(c, 0), 0)).when(
        c == F.floor(c), c.cast("long").cast("string")
    ).otherwise(F.format_string("%.2f", c))


def salary_display(low: Column, high: Column, interval: Column, currency: Column | None = None) -> Column:
    """``$a - $b/hr``; one amount if the bounds are equal to the cent or one is null; null without any."""
    currency = F.lit("USD") if currency is None else F.upper(F.coalesce(currency, F.lit("USD")))
    sign = F.when(currency == "USD", "$").otherwise(F.concat(currency, F.lit(" ")))
    suffix = F.lit("")
    for name, (_, short) in INTERVALS.items():
        suffix = F.when(interval == name, short).otherwise(suffix)
    two = low.isNotNull() & high.isNotNull() & (F.bround(low, 2) != F.bround(high, 2))
    text = F.when(
        two, F.concat(sign, amount_text(low), F.lit(" - "), sign, amount_text(high))
    ).otherwise(F.concat(sign, amount_text(F.coalesce(low, high))))
    return F.when(low.isNotNull() | high.isNotNull(), F.concat(text, suffix))


def pay_interval(text: Column) -> Column:
    return first_label(text, {k: p for k, (p, _) in INTERVALS.items()}, None)


def _segments(text: Column) -> Column:
    """The whole text and its parts that hold a digit, the first spelling of equal ones, in order; by sorting, so long texts are fine."""
    parts = lambda w: F.filter(F.transform(F.split(w, r"\s*\|\s*|(?<=[.;])\s+"), squeeze), lambda p: F.length(p) >= 3)
    keyed = lambda v: F.array_sort(F.transform(v, lambda s, i: F.struct(fold(s).alias("k"), i.alias("i"), s.alias("s"))))

    def firsts(v: Column) -> Column:
        before = F.concat(F.slice(v, 1, 0), F.array(F.lit(None)), F.slice(v, 1, F.size(v) - 1))
        new = F.zip_with(v, before, lambda a, b: F.when(b.isNull() | (a["k"] != b["k"]), F.struct(a["i"].alias("i"), a["s"].alias("s"))))
        return F.transform(F.array_sort(F.array_compact(new)), lambda x: x["s"])

    # amounts are digits: a part without any has no candidate
    told = lambda v: F.filter(v, lambda s: s.rlike("[0-9]"))
    return let(squeeze(text), lambda w: F.when(w.rlike("[0-9]"), let(keyed(told(F.concat(F.array(w), parts(w)))), firsts)).otherwise(F.array().cast("array<string>")))


_CANDIDATE = "array<struct<score:int,len:int,timed:int,seg:int,pat:int,nth:int,low:double,high:double,interval:string>>"


def _candidates(segment: Column, seg_no: Column, pattern: str, ranged: bool, order: int) -> Column:
    """Scored candidates of one pattern in one segment; matches do not overlap, their suffix is part of them.

    One pass marks the matches; their windows (24 characters before to 48 after) are put together from the nearest
    pieces, as many as so many characters can take up, and their groups are read from the matches alone.
    """
    pieces = F.split(F.regexp_replace(segment, rf"(?i){pattern}", "\u0001$0\u0002"), "[\u0001\u0002]")
    groups = 5 if ranged else 3

    def located(p: Column, near: Column, i: Column) -> Column:
        body = F.get(p, i)
        first = F.greatest(i - 2 * BEFORE, F.lit(0))
        before = F.right(F.array_join(F.slice(near["tails"], first + 1, i - first), ""), F.lit(BEFORE))
        after = F.left(F.array_join(F.slice(near["heads"], i + 2, 2 * AFTER), ""), F.lit(AFTER))
        return F.struct(
            F.concat(before, body, after).alias("window"),
            *[F.regexp_extract(body, rf"(?i)^(?:{pattern})$", g + 1).alias(f"g{g}") for g in range(groups)]
        )

    odd = lambda p: F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    clipped = lambda p: F.struct(
        F.transform(p, lambda x: F.right(x, F.lit(BEFORE))).alias("tails"),
        F.transform(p, lambda x: F.left(x, F.lit(AFTER))).alias("heads")
    )
    matches = let(pieces, lambda p: let(clipped(p), lambda near: F.transform(odd(p), lambda i: located(p, near, i))))

    def scored(m: Column, i: Column) -> Column:
        suffix = m["g4"] if ranged else m["g2"]
        signed = (m["g0"] != "") | ((m["g2"] != "") if ranged else F.lit(False))
        seen = let(m["window"], lambda w: F.struct(
            F.length(w).alias("len"), (signed | w.contains("$") | F.lower(w).contains("usd")).alias("currency"), _has(
                w, PAY_CONTEXT if ranged else PAY_CONTEXT_SINGLE
            ).alias("context"),
            pay_interval(F.when(suffix != "", suffix).otherwise(w)).alias("interval"), _has(w, PAY_WORD).alias("word"), _has(w, YEARS_RANGE).alias("years"), _has(w, OF_EXPERIENCE).alias("experience"),
            amount(m["g1"]).alias("low"), amount(m["g3"] if ranged else m["g1"]).alias("high"),
        ))

        def judged(x: Column) -> Column:
            low, high = x["low"], x["high"]
            score = (
                F.when(x["currency"], 8).otherwise(0) + F.when(x["context"], 4).otherwise(0) + F.when(x["interval"].isNotNull(), 5).otherwise(0)
                + F.when(
                    F.bround(low, 2) != F.bround(high, 2), 8
                ).otherwise(0) + F.when(low >= 1000, 2).otherwise(0) + F.when(high >= 1000, 2).otherwise(0)
                + F.when(x["word"], 2).otherwise(0) + F.when(x["years"], -12).otherwise(0)
            )
            fits = (x["currency"] | x["context"]) & ~x["experience"] & low.isNotNull() & high.isNotNull() & (high >= low)
            fits = fits & ~x["years"] if ranged else fits
            timed = F.when(x["interval"].isNotNull(), 1).otherwise(0)
            place = ((-seg_no).alias("seg"), F.lit(-order).alias("pat"), (-i).alias("nth"))
            return F.when(
                fits,
                F.struct(
                    score.cast("int").alias("score"), x["len"].alias("len"), timed.alias("timed"), *place, low.alias("low"),
                    high.alias("high"), x["interval"].alias("interval")
                )
            )

        return let(seen, judged)

    return F.array_compact(F.transform(matches, scored)).cast(_CANDIDATE)


def salary(text: Column) -> Column:
    """struct(low, high, currency, interval, display): the best-scored candidate of all segments, first of equals."""
    # beside each pattern what must stand in a segment for it to be found there, which is quicker to look for
    patterns = (
        (RANGE, True, r"(?i)[0-9]\s*[km]?\s*(?:[-–—]|to|and|through|up to)"), (DASHED, True, "[–—]"),
        (NAMED, False, r"(?i)salary|compensation|pay|hourly rate"), (BOUNDED, False, r"(?i)start(?:ing|s) at|from|up to|m(?:in|ax)imum of")
    )
    none = F.array().cast(_CANDIDATE)
    found = F.flatten(F.transform(_segments(text), lambda s, n: F.flatten(F.array(*[
        F.when(s.rlike(sign), _candidates(s, n, p, ranged, i)).otherwise(none) for i, (p, ranged, sign) in enumerate(patterns)
    ]))))

    def shown(best: Column) -> Column:
        display = salary_display(best["low"], best["high"], best["interval"])
        return F.struct(
            best["low"].alias("low"), best["high"].alias("high"), F.when(best.isNotNull(), "USD").alias("currency"),
            best["interval"].alias("interval"), display.alias("display")
        )

    return let(F.array_max(found), shown)


# Words of employment terms that are not pay.
EMPLOYMENT_NOISE = r"\b(?:contract|full[\s-]?time|part[\s-]?time|temporary|temp[\s-]?to[\s-]?hire|day shift|night shift|weekends?|overtime|remote|hybrid|on[\s-]?site|work setting)\b"
EMPLOYMENT_FRAGMENT = r"\b(?:full[\s-]?time|part[\s-]?time|contract|temporary|temp[\s-]?to[\s-]?hire|internship|day shift|night shift|weekends?|overtime|monday to friday)\b"
PLACEHOLDERS = ("", "unspecified", "not specified", "salary not specified", "clearance unspecified", "career level not specified")
PAY_TERMS = r"\b(?:salary|compensation|pay(?: range)?|hourly|annual|per hour|per year|a year|an hour)\b"
CHALLENGES = (
    "additional verification required", "attention required", "cloudflare", "enable javascript and cookies to continue",
    "just a moment", "ray id", "security check - indeed.com", "troubleshooting cloudflare errors",
)


def _worth(text: Column, info: Column) -> Column:
    """How good a text, with what ``salary`` reads from it, is as a salary line: struct(score, -length)."""

    def ranked(noise: Column) -> Column:
        shown = info["display"].isNotNull()
        points = (
            (shown, 20), (info["low"].isNotNull(), 3), (F.bround(info["low"], 2) != F.bround(info["high"], 2), 8), (info["interval"].isNotNull(), 5),
            (_has(text, PAY_TERMS), 4), (
                F.regexp_count(text, F.lit(r"\$")) >= 2, 3
            ), (_has(text, YEARS_RANGE), -12), (noise, -6), (shown & ~noise & ~text.contains("|"), 2),
        )
        score = F.lit(0)
        for holds, n in points:
            score = score + F.when(holds, n).otherwise(0)
        return F.struct(score.alias("score"), (-F.length(text)).alias("shorter"))

    return let(_has(text, EMPLOYMENT_NOISE), ranked)


def salary_rank(text: Column) -> Column:
    """How good a text is as the salary line of a posting; shorter wins among equals (struct score, -length)."""
    return let(salary(text), lambda info: _worth(text, info))


def best_salary(texts: Column, readable: bool = True) -> Column:
    """Of several texts the best as the salary line, the first of equals; empty if there is none.

    With ``readable`` placeholders are left out, and texts from which no pay can be read.
    """
    rows = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), squeeze), lambda t: t != "")
    rows = F.transform(rows, lambda t: F.struct(t.alias("text"), salary(t).alias("info")))
    if readable:
        rows = F.filter(rows, lambda r: ~placeholder(r["text"]) & r["info"]["display"].isNotNull())
    ranked = F.transform(rows, lambda r, i: F.struct(_worth(r["text"], r["info"]).alias("rank"), (-i).alias("first"), r["text"].alias("text")))
    return F.coalesce(F.array_max(ranked)["text"], F.lit(""))


def clearance_token(text: Column) -> Column:
    """Whether a short text names a clearance."""
    return F.size(clearance(text)["terms"]) > 0


def placeholder(text: Column) -> Column:
    return fold(squeeze(text)).isin(*PLACEHOLDERS)


def employment_fragment(text: Column) -> Column:
    return _has(squeeze(text), EMPLOYMENT_FRAGMENT)


def challenge_page(text: Column) -> Column:
    """A page that asks for verification instead of showing postings."""
    folded, out = fold(F.coalesce(text, F.lit(""))), F.lit(False)
    for marker in CHALLENGES:
        out = out | folded.contains(marker)
    return out
