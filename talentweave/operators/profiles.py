"""Profiles from résumé texts: lines, sections, titles, spans, history, education, contacts, summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions.dates import partial_date
from talentweave.functions.text import EMAIL, LINK, PHONE, blank, clean_text, distinct_folded, filled, first_match, fold, let, squeeze, text_hash
from talentweave.operators.annotate import clearance, years_mentioned
from talentweave.operators.dedupe import keep_first
from talentweave.operators.terms import in_categories, terms_column

# ---- fixed values: headers, words and patterns of résumés ---------------------------------------------------
HEADERS = {
    "summary": ("summary", "professional summary", "profile", "about", "objective"),
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "career history"),
    "skills": ("skills", "technical skills", "core competencies", "technologies", "technical proficiencies"),
    "education": ("education", "certifications", "education and certifications"),
    "projects": ("projects", "selected projects"),
}
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_RANGE = rf"(?i)((?:{MONTH}\s+)?\d{{4}}|\d{{1,2}}/\d{{4}})\s*(?:-|–|—|to)\s*(present|current|now|(?:{MONTH}\s+)?\d{{4}}|\d{{1,2}}/\d{{4}})"
TITLE_WORDS = (
    "administrator", "analyst", "architect", "consultant", "coordinator", "developer", "director", "engineer", "lead", "manager",
    "operator", "owner", "scientist", "specialist", "support", "technician"
)
COMPANY_WORDS = ("inc", "llc", "corp", "corporation", "ltd", "university", "systems", "solutions", "company")
DEGREE_WORDS = ("bachelor", "master", "associate", "phd", "doctor", "certificate", "certification", "b.s", "b.a", "m.s", "m.a")
BULLET = r"^[-*•]"
TITLES, HISTORY, EDUCATION, HIGHLIGHTS = 8, 8, 6, 4


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return fold(c).rlike("|".join(w.replace(".", r"\.") for w in words))


def lines(texts: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(resume_id, pos, line): squeezed lines without blank ones and page marks; null texts have none."""
    rows = texts.select(F.col(key).alias("resume_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\f]")).alias("pos", "raw"))
    rows = rows.select("resume_id", "pos", squeeze(F.col("raw")).alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike(r"(?i)^page \d+( of \d+)?$"))


def header(line: Column) -> Column:
    """The section that a line heads, or null."""
    compact = F.trim(F.regexp_replace(F.lower(F.regexp_replace(squeeze(line), "^:+|:+$", "")), "[^a-z ]+", ""))
    out = F.lit(None).cast("string")
    for name, options in reversed(list(HEADERS.items())):
        out = F.when(compact.isin(*options), name).otherwise(out)
    return out


def sectioned(rows: DataFrame, heads: Column | None = None, first: str = "summary") -> DataFrame:
    """Lines with the section of the last header before them; the header lines go."""
    heads = header(F.col("line")) if heads is None else heads
    w = Window.partitionBy("resume_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("head", heads).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(first)))
    return out.where("head is null").drop("head")


def ordered_text(line: Column, pos: Column, by: str = "\n") -> Column:
    """Aggregate: lines in order as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), line.alias("l")))), lambda x: x["l"]), by)


def sections(rows: DataFrame) -> DataFrame:
    """(resume_id, sections): a map of section texts."""
    texts = sectioned(rows).groupBy("resume_id", "section").agg(ordered_text(F.col("line"), F.col("pos")).alias("text"))
    return texts.groupBy("resume_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "text")))).alias("sections"))


def dated(line: Column) -> Column:
    return line.rlike(DATE_RANGE)


def clean_title(c: Column) -> Column:
    """A title without what follows a bar, ``at`` or a wide gap, and without loose marks."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\|.*$", ""), r"(?i)\bat\b.*$", ""), r"\s{2,}.*$", "")
    return squeeze(F.regexp_replace(cut, r"^[,\-| ]+|[,\-| ]+$", ""))


def split_title(c: Column) -> Column:
    """struct(title, company) of ``Title | Company`` or ``Title at Company``."""
    text = squeeze(c)
    bar, at = text.contains("|"), fold(text).contains(" at ")
    title = F.when(bar, F.regexp_extract(text, r"^([^|]*)\|", 1)).when(at, F.regexp_extract(text, r"(?i)^(.*?)\bat\b", 1)).otherwise(text)
    company = F.when(bar, F.regexp_extract(text, r"^[^|]*\|(.*)$", 1)).when(at, F.regexp_extract(text, r"(?i)^.*?\bat\b(.*)$", 1)).otherwise("")
    return F.struct(squeeze(title).alias("title"), squeeze(company).alias("company"))


def _before_dates(line: Column) -> Column:
    return F.regexp_extract(line, rf"(?is)^(.*?)(?:{DATE_RANGE[4:]})", 1)


def recent_titles(experience: DataFrame) -> DataFrame:
    """(resume_id, titles): at most 8 different titles in order, from lines (resume_id, pos, line)."""
    line = F.col("line")
    prefix = squeeze(_before_dates(line))
    plain = ~line.rlike(BULLET) & ~line.contains("@") & ~line.contains("http") & (F.length(line) <= 90) & _any(line, TITLE_WORDS)
    company = _any(line, COMPANY_WORDS) & ~line.contains("|") & ~fold(line).contains(" at ")
    title = F.when(dated(line), F.when(prefix != "", clean_title(prefix))).when(plain & ~company, clean_title(line))
    rows = experience.withColumn("title", title).where(F.length("title") >= 3)
    rows = keep_first(rows, ["resume_id", fold(F.col("title"))], ["pos"])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("resume_id").orderBy("pos"))).where(F.col("n") <= TITLES)
    return rows.groupBy("resume_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))


def spans(texts: DataFrame, as_of: dt.date, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(resume_id, pos, start, end, label): date ranges of the texts whose end is not before their start."""
    found = F.regexp_extract_all(F.col(text), F.lit(DATE_RANGE), 0)  # one walk of the text; a range tells its ends
    rows = texts.select(F.col(key).alias("resume_id"), F.posexplode(found).alias("pos", "label"))
    end = lambda i: partial_date(F.regexp_extract("label", DATE_RANGE, i), as_of)
    rows = rows.select("resume_id", "pos", end(1).alias("start"), end(2).alias("end"), "label")
    return rows.where("start is not null and end >= start")


def merged_spans(spans_: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, first, last): what the spans of each key cover, in months since year 0; spans that meet or overlap are one.

    Spans are combined by first month before they are moved, so a key has no more rows to put in order than months.
    A running maximum of their ends tells where a gap begins.
    """
    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    rows = spans_.select(key, month(F.col("start")).alias("first"), month(F.col("end")).alias("last")).where("last >= first")
    rows = rows.groupBy(key, "first").agg(F.max("last").alias("last"))
    w = Window.partitionBy(key).orderBy("first")
    rows = rows.withColumn("before", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.when(F.col("before") + 1 >= F.col("first"), 0).otherwise(1)
    rows = rows.withColumn("n", F.sum(gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("n")


def months_covered(spans_: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, months): months in at least one span."""
    return merged_spans(spans_, key).groupBy(key).agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("months"))


def experience_years(texts: DataFrame, as_of: dt.date) -> DataFrame:
    """(resume_id, experience_years): months covered over 12 to one place, else the most years mentioned, else 0."""
    months = months_covered(spans(texts, as_of))
    rows = texts.select("resume_id", years_mentioned(F.col("text")).alias("told")).join(months.hint("merge"), "resume_id", "left")
    return rows.select("resume_id", F.coalesce(F.bround(F.col("months") / 12, 1), "told", F.lit(0.0)).alias("experience_years"))


def segments(rows: DataFrame, starts: Column) -> DataFrame:
    """Lines with the number of the segment they are in (0 before the first start)."""
    w = Window.partitionBy("resume_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def work_history(experience: DataFrame, as_of: dt.date) -> DataFrame:
    """(resume_id, n, title, company, location, start_date, end_date, is_current, description): at most 8 entries.

    A dated line starts an entry; its title stands before the dates, else in the last plain line before.  The first
    plain line that splits into title and company gives a missing company; a later one with a comma the place.
    """
    line, w = F.col("line"), Window.partitionBy("resume_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    heads, plain = F.col("_dated"), F.col("_plain")  # columns of their own below the windows, so that they are worked out once
    experience = experience.select("resume_id", "pos", "line", dated(line).alias("_dated")).withColumn("_plain", ~heads & ~line.rlike(BULLET))
    rows = segments(experience, heads).withColumn("plain_before", F.last(F.when(plain, line), ignorenulls=True).over(before))
    rows = rows.where("segment > 0").withColumn("parts", let(
        F.when(heads, clean_title(_before_dates(line))).otherwise(line),
        lambda t: let(split_title(t), lambda p: F.when(heads & (p["title"] == ""), split_title(F.col("plain_before"))).otherwise(p))
    ))
    gives = plain & (F.col("parts.company") != "")
    head = lambda c: F.min_by(F.when(heads, c), F.when(heads, F.col("pos")))
    found = rows.groupBy("resume_id", "segment").agg(
        F.min("pos").alias("pos"), head(F.col("parts.title")).alias("title"), head(F.col("parts.company")).alias("company"),
        F.min_by(F.when(gives, F.col("parts")), F.when(gives, F.col("pos"))).alias("named"),
        head(F.regexp_extract(line, DATE_RANGE, 1)).alias("a"), head(F.regexp_extract(line, DATE_RANGE, 2)).alias("b"),
        F.array_sort(
            F.collect_list(F.when(plain & line.contains(",") & (F.length(line) <= 90), F.struct("pos", "line", gives.alias("gives"))))
        ).alias("places"),
        squeeze(ordered_text(F.when(line.rlike(BULLET), F.regexp_replace(line, r"^[-*• ]+", "")), F.col("pos"), " ")).alias("description"),
    )
    lacks = blank(F.col("company")) & F.col("named").isNotNull()
    places = F.filter("places", lambda p: ~(lacks & p["gives"]))
    found = found.select(
        "resume_id", "pos", F.when(
            lacks & blank(F.col("title")), F.col("named.title")
        ).otherwise(F.col("title")).alias("title"), F.when(lacks, F.col("named.company")).otherwise(F.col("company")).alias("company"),
        F.coalesce(F.get(places, 0)["line"], F.lit("")).alias("location"), partial_date(F.col("a"), as_of).alias("start_date"), partial_date(F.col("b"), as_of).alias("end_date"),
        F.lower("b").isin("present", "current", "now").alias("is_current"), "description",
    )
    found = keep_first(
        found, ["resume_id", fold(F.col("title")), fold(F.col("company")), "start_date"], ["pos"]
    ).where("title <> '' or company <> ''")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= HISTORY).drop("pos")


def history_of(experience: DataFrame, spans_: DataFrame, as_of: dt.date) -> DataFrame:
    """``work_history``; a résumé without any entry gets its first spans paired with its first titles, at most 4."""
    found = work_history(experience, as_of)
    w = Window.partitionBy("resume_id").orderBy("pos")
    times = spans_.withColumn("n", F.row_number().over(w)).where("n <= 4").select(
        "resume_id", "n", F.col("start").alias("start_date"), F.col("end").alias("end_date"),
        F.lower("label").rlike("present$").alias("is_current")
    )
    names = recent_titles(experience).select(
        "resume_id", F.posexplode(F.slice("titles", 1, 4)).alias("at", "title")
    ).select("resume_id", (F.col("at") + 1).alias("n"), "title")
    pairs = times.join(names.hint("merge"), ["resume_id", "n"]).join(found.select("resume_id").distinct().hint("merge"), "resume_id", "left_anti")
    none = {c: F.lit("") for c in ("company", "location", "description")}
    return found.unionByName(pairs.withColumns(none).select(*found.columns))


def education(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """(resume_id, n, school, degree, start_date, end_date, description): at most 6 entries.

    A line with a degree or dates starts an entry, the next is the school, the rest its description.  Without any
    such line the first 4 lines are schools.
    """
    line, w = F.col("line"), Window.partitionBy("resume_id").orderBy("pos")
    starts = _any(line, DEGREE_WORDS) | dated(line)
    numbered = segments(rows, starts).withColumn("any", F.max(starts).over(Window.partitionBy("resume_id"))).withColumn(
        "place", F.row_number().over(Window.partitionBy("resume_id", "segment").orderBy("pos"))
    )
    entries = numbered.where("segment > 0").groupBy("resume_id", F.col("segment").cast("int").alias("n")).agg(
        F.coalesce(F.min_by("line", F.when(F.col("place") == 2, F.col("place"))), F.lit("")).alias("school"),
        F.min_by(
            F.when(_any(line, DEGREE_WORDS), F.when(dated(line), clean_title(_before_dates(line))).otherwise(line)).otherwise(""),
            "place"
        ).alias("degree"),
        F.min_by(
            partial_date(F.regexp_extract(line, DATE_RANGE, 1), as_of), "place"
        ).alias("start_date"), F.min_by(partial_date(F.regexp_extract(line, DATE_RANGE, 2), as_of), "place").alias("end_date"),
        squeeze(ordered_text(F.when(F.col("place") > 2, line), F.col("pos"), " ")).alias("description"),
    )
    nothing = numbered.where("not any and place <= 4").select(
        "resume_id", F.col("place").alias("n"), F.col("line").alias("school"), F.lit("").alias("degree"),
        F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit("").alias("description")
    )
    return entries.unionByName(nothing).where(F.col("n") <= EDUCATION)


def contacts(rows: DataFrame) -> DataFrame:
    """(resume_id, full_name, email, phone, linkedin_url, website_url, location) from the first 20 lines."""
    line = F.col("line")
    n = rows.withColumn("n", F.row_number().over(Window.partitionBy("resume_id").orderBy("pos"))).where("n <= 20")
    contact = line.rlike(EMAIL) | line.rlike(PHONE) | line.rlike(r"(?i)https?://|www\.")
    named = (F.col("n") <= 10) & ~contact & (F.size(F.split(line, " ")) <= 5) & header(line).isNull() & ~line.rlike(r"\d")
    site = first_match(line, LINK)
    linked = first_match(line, r"(?i)(?:https?://(?:www\.)?)?linkedin\.com/\S+")
    n = n.withColumn("name_n", F.min(F.when(named, F.col("n"))).over(Window.partitionBy("resume_id")))
    place = (F.col("n") <= 10) & ~contact & line.contains(",") & (F.length(line) <= 80) & ~F.col("n").eqNullSafe(F.col("name_n"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(c.isNotNull(), F.col("n"))), F.lit(""))
    return n.groupBy("resume_id").agg(
        first(F.when(named, line)).alias("full_name"), first(first_match(line, EMAIL)).alias("email"), first(first_match(line, PHONE)).alias("phone"), first(linked).alias("linkedin_url"),
        first(F.when(~F.lower(site).contains("linkedin.com"), site)).alias("website_url"), first(F.when(place, line)).alias("location"),
    )


def highlights(experience: DataFrame) -> DataFrame:
    """(resume_id, highlights): the first 4 bullets and title lines, joined by bars."""
    line = F.col("line")
    rows = experience.where(line.rlike(BULLET) | _any(line, TITLE_WORDS)).withColumn(
        "n", F.row_number().over(Window.partitionBy("resume_id").orderBy("pos"))
    ).where(F.col("n") <= HIGHLIGHTS)
    return rows.groupBy("resume_id").agg(ordered_text(F.regexp_replace(line, r"^[-*• ]+", ""), F.col("pos"), " | ").alias("highlights"))


def summary_text(
    skills: Column, tools: Column, certifications: Column, cleared: Column, titles: Column, years: Column, summary: Column,
    highlights_: Column, projects: Column, headline: Column | None = None
) -> Column:
    def listed(name: str, c: Column, n: int) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(c, 1, n), ", ")))

    def told(name: str, c: Column) -> Column:
        return F.when(~blank(c), F.concat(F.lit(f"{name}: "), c))

    return F.concat_ws(
        "\n", told("Headline", F.lit("") if headline is None else headline), listed("Recent titles", titles, 6),
        listed("Skills", skills, 30), listed("Tools and platforms", tools, 22), listed("Certifications", certifications, 12),
        listed("Clearance", cleared, 99),
        F.when(years > 0, F.concat(F.lit("Estimated experience: "), F.format_string("%.1f", years), F.lit(" years"))),
        told("Profile", summary), told("Experience highlights", highlights_), told("Projects", projects)
    )


def structure(
    texts: DataFrame, skills: dict[str, list[str]], categories: dict[str, str], certifications: dict[str, list[str]],
    as_of: dt.date, tool_categories: tuple[str, ...] = ("tool", "platform", "cloud", "data", "analytics", "runtime"),
    least: int = 40
) -> DataFrame:
    """One profile a text (resume_id, text): all of the above; texts under ``least`` characters are left out."""
    texts = texts.where(F.length(squeeze(F.col("text"))) >= least)
    rows = lines(texts)
    parts = sections(rows)
    experience = sectioned(rows).where("section = 'experience'").drop("section")
    out = texts
    for found in (parts, recent_titles(experience), experience_years(texts, as_of), highlights(experience), contacts(rows)):
        out = out.join(found.hint("merge"), "resume_id", "left")  # all by the same key, so texts are shuffled once
    part = lambda name: F.coalesce(F.try_element_at("sections", F.lit(name)), F.lit(""))
    base = F.concat_ws("\n", part("skills"), part("summary"), filled(part("experience"), F.col("text")), part("projects"))
    out = out.withColumns(
        {
            "skills": terms_column(base, skills), "certifications": terms_column(F.col("text"), certifications),
            "clearance_terms": clearance(F.col("text"))["terms"], "titles": F.coalesce("titles", F.array().cast("array<string>"))
        }
    )
    out = out.withColumn("tools", in_categories(F.col("skills"), categories, tool_categories))
    summary = summary_text(
        F.col("skills"), F.col("tools"), F.col("certifications"), F.col("clearance_terms"), F.col("titles"),
        F.col("experience_years"), squeeze(part("summary")), F.coalesce("highlights", F.lit("")), part("projects")
    )
    return out.withColumn("summary_text", summary).withColumn("content_hash", text_hash(F.col("summary_text")))


def edit(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited lists and basics over the stored ones (nulls keep), empty entries dropped, summary anew, vector reset."""
    lists = [c for c in ("skills", "tools", "certifications", "clearance_terms", "titles") if c in edits.columns]
    new = edits.select("resume_id", *[F.col(c).alias(f"e_{c}") for c in edits.columns if c != "resume_id"])
    rows = profiles.join(new, "resume_id", "left")
    clean = lambda c: F.filter(F.transform(c, squeeze), lambda x: x != "")
    rows = rows.withColumns({c: F.coalesce(clean(F.col(f"e_{c}")), F.col(c)) for c in lists})
    headline = F.coalesce("e_headline", F.lit("")) if "headline" in edits.columns else F.lit("")
    changed = F.coalesce(*[F.col(c).isNotNull() for c in new.columns if c != "resume_id"][:1], F.lit(False))
    summary = summary_text(
        F.col("skills"), F.col("tools"), F.col("certifications"), F.col("clearance_terms"), F.col("titles"),
        F.col("experience_years"), F.lit(""), F.lit(""), F.lit(""), headline
    )
    rows = rows.withColumns(
        {
            "summary_text": F.when(changed, summary).otherwise(F.col("summary_text")),
            "embedding": F.when(~changed, F.col("embedding").cast("array<double>"))
        }
    )
    return rows.select(*profiles.columns)


# ---- the nested profile that forms fill in ------------------------------------------------------------------
_BASICS = ("full_name", "email", "phone", "location", "linkedin_url", "website_url", "headline", "summary")
_WORK, _SCHOOL = ("title", "company", "location", "start_date", "end_date"), ("school", "degree", "field_of_study", "start_date", "end_date")
_LISTS = ("skills", "tools", "certifications", "clearance_terms")
#: A profile as one struct; experience_years stands beside the basics, since either may be given.
PROFILE = (
    f"struct<basics:struct<{','.join(f'{c}:string' for c in _BASICS)},years_experience:double>,"
    f"work_history:array<struct<{','.join(f'{c}:string' for c in _WORK)},is_current:boolean,description:string>>,"
    f"education:array<struct<{','.join(f'{c}:string' for c in _SCHOOL)},description:string>>,"
    f"{','.join(f'{c}:array<string>' for c in _LISTS)},recent_titles:array<string>,experience_years:double>"
)


def normal_profile(profile: Column) -> Column:
    """A profile (PROFILE) with clean texts: entries that say nothing and repeated list entries go, titles are
    the headline and those of the history, at most 8; nulls become empty; years are those given, else those of the basics."""
    basics = profile["basics"]
    years = lambda a, b: F.coalesce(F.nullif(a, F.lit(0.0)), b, F.lit(0.0))

    def entries(items: Column, names: tuple[str, ...], telling: tuple[str, ...], *more: str) -> Column:
        says = lambda x: ~F.forall(F.array(*[squeeze(x[c]) for c in telling]), lambda t: t == "")
        clean = lambda x: F.struct(
            *[squeeze(x[c]).alias(c) for c in names], *[F.coalesce(x[c], F.lit(False)).alias(c) for c in more],
            clean_text(x["description"]).alias("description")
        )
        return F.coalesce(
            F.transform(F.filter(items, says), clean),
            F.array().cast(f"array<struct<{','.join([*(f'{c}:string' for c in names), *(f'{c}:boolean' for c in more), 'description:string'])}>>")
        )

    history = entries(profile["work_history"], _WORK, ("title", "company", "description"), "is_current")
    titles = F.slice(distinct_folded(F.concat(F.array(basics["headline"]), F.transform(history, lambda x: x["title"]))), 1, TITLES)
    return F.struct(
        F.struct(
            *[squeeze(basics[c]).alias(c) for c in _BASICS],
            years(basics["years_experience"], profile["experience_years"]).alias("years_experience")
        ).alias("basics"),
        history.alias("work_history"), entries(profile["education"], _SCHOOL, ("school", "degree", "description")).alias("education"),
        *[distinct_folded(profile[c]).alias(c) for c in _LISTS], titles.alias("recent_titles"), years(
            profile["experience_years"], basics["years_experience"]
        ).alias("experience_years"),
    ).cast(PROFILE)


def nested_summary(profile: Column, projects: Column) -> Column:
    """The summary of a normalised profile; of the first 4 entries of the history title, company and 180 characters."""
    told = lambda x: F.concat_ws(
        " | ", F.nullif(x["title"], F.lit("")), F.nullif(x["company"], F.lit("")),
        F.nullif(F.rtrim(F.substring(squeeze(x["description"]), 1, 180)), F.lit(""))
    )
    work = F.array_join(F.filter(F.transform(F.slice(profile["work_history"], 1, 4), told), lambda t: t != ""), " || ")
    basics = profile["basics"]
    return summary_text(
        profile["skills"], profile["tools"], profile["certifications"], profile["clearance_terms"], profile["recent_titles"],
        profile["experience_years"], basics["summary"], work, projects, basics["headline"]
    )


def edit_profiles(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Profiles after edits (resume_id, profile as PROFILE): lists, titles, years, summary and profile are the edited
    ones, and the vector goes; profiles without an edit stay as they are."""
    new = edits.select("resume_id", normal_profile(F.col("profile").cast(PROFILE)).alias("e"))
    rows = profiles.join(new.hint("merge"), "resume_id", "left")
    e, done = F.col("e"), F.col("e").isNotNull()
    projects = F.coalesce(F.try_element_at("sections", F.lit("projects")), F.lit("")) if "sections" in profiles.columns else F.lit("")
    changed = {c: e[c] for c in (*_LISTS, "experience_years")} | {
        "titles": e["recent_titles"], "profile": e, "summary_text": nested_summary(e, projects),
        "embedding": F.lit(None).cast("array<double>")
    }
    changed["content_hash"] = text_hash(changed["summary_text"])
    return rows.select(*[(F.when(done, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in profiles.columns])


def single_active(profiles: DataFrame) -> DataFrame:
    """Only the last created profile of each owner is active; of equal file hashes the latest stays."""
    kept = keep_first(profiles, ["owner", "file_hash"], [F.desc("created_at"), F.desc("id")])
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("id"))
    return kept.withColumn("is_active", F.row_number().over(w) == 1)
