"""Postings on captured pages of job boards: cards of list pages and whole postings of detail pages, by layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentweave.functions.text import blank, filled, fold, squeeze
from talentweave.functions.urls import absolute_url
from talentweave.operators.annotate import best_salary, clearance_token, employment_fragment, placeholder
from talentweave.operators.extract import extract_layout, extract_layouts, jsonld_postings
from talentweave.operators.filters import job_like

# Where the layouts of the boards have their fields (layout, scope, field, selectors in order).
LAYOUTS = (
    ("indeed", "card", "container", ("[data-jk]", "[data-testid='slider_item']", "a[href*='/viewjob']", "a[href*='clk?jk=']")),
    ("indeed", "card", "raw_id", ("@data-jk", "a:@data-jk")),
    ("indeed", "card", "title", ("a:",)),
    ("indeed", "card", "href", ("a:@href",)),
    ("indeed", "card", "company", (".companyName", "[data-testid='company-name']", "span.companyName")),
    ("indeed", "card", "location", (".companyLocation", "[data-testid='text-location']")),
    ("indeed", "card", "summary", (".job-snippet", "[data-testid='job-snippet']")),
    (
        "indeed", "card", "salary[]",
        (".salary-snippet", ".salary-snippet-container", ".estimated-salary", "[class*='salary']", "[data-testid='attribute_snippet_testid']")
    ),
    ("indeed", "card", "posted_at", (".date", "[data-testid='myJobsStateDate']")),
    ("clearance", "card", "container", (".job-search-list-item-desktop", "article, .job, .job-listing, li")),
    ("clearance", "card", "title", ("a.job-search-list-item-desktop__job-name[href]", "a:")),
    ("clearance", "card", "href", ("a.job-search-list-item-desktop__job-name[href]@href", "a:@href")),
    ("clearance", "card", "company", (".job-search-list-item-desktop__company-name", ".company", ".job-company", "[data-testid='company']")),
    ("clearance", "card", "location", (".job-search-list-item-desktop__location", ".location", ".job-location", "[data-testid='location']")),
    ("clearance", "card", "summary", (".job-search-list-item-desktop__description", ".description", ".job-description", "p")),
    ("clearance", "card", "tokens[]", (".job-search-list-item-desktop__footer > div > div",)),
    ("clearance", "card", "groups[]", (".job-search-list-item-desktop__footer > div",)),
    ("clearance", "card", "footer[]", (".job-search-list-item-desktop__footer",)),
    ("clearance", "card", "salary[]", (".salary", ".salary-range", ".compensation", "[class*='salary']")),
    ("generic", "card", "container", ("article, li, .job, .posting, .job-listing, .result",)),
    ("generic", "card", "title", ("a:",)),
    ("generic", "card", "href", ("a:@href",)),
    ("generic", "card", "company", (".company", ".posting-company", "[itemprop='hiringOrganization']")),
    ("generic", "card", "location", (".location", "[itemprop='jobLocation']")),
    ("generic", "card", "summary", (".description", ".summary", "p")),
    ("generic", "card", "salary[]", (".salary", ".salary-range", ".compensation", "[class*='salary']")),
    ("clearance", "detail", "title", ("h1.job-view-header-content__top__job-name", ".job-view-header-content__top__job-name", "h1")),
    (
        "clearance", "detail", "company",
        ("h2.job-view-header-content__top__job-company", ".job-view-header-content__top__job-company a", ".job-view-header-content__top__job-company")
    ),
    (
        "clearance", "detail", "location",
        (".job-info .job-fit__nonSkills--location .el-tag__content", ".job-view-header-content__top__location", "[data-testid='job-location']")
    ),
    ("clearance", "detail", "description", (".job-description",)),
    ("clearance", "detail", "requirements_text", (".job-info",)),
    (
        "clearance", "detail", "salary[]",
        (".job-info .job-fit__nonSkills--salary .el-tag__content", ".job-info .salary-estimate-link", ".job-info [class*='salary']")
    ),
    (
        "clearance", "detail", "employment[]",
        (
            ".job-info .job-fit__nonSkills--careerLevel .el-tag__content",
            ".job-info .job-fit__nonSkills--location .el-tag__content", ".job-info .job-fit__nonSkills--required .el-tag__content"
        )
    ),
    ("clearance", "detail", "posted_at", (".job-view-header-content time", ".posted-date", "time")),
    (
        "generic", "detail", "title",
        ("h1", "[data-testid='jobsearch-JobInfoHeader-title']", "[data-testid='viewJobTitle']", "[itemprop='title']", "title")
    ),
    (
        "generic", "detail", "company",
        (
            ".companyName", "[data-testid='inlineHeader-companyName']", "[data-company-name='true']",
            ".jobsearch-CompanyInfoContainer a", "[itemprop='hiringOrganization']"
        )
    ),
    (
        "generic", "detail", "location",
        (".companyLocation", "[data-testid='inlineHeader-companyLocation']", "[data-testid='job-location']", "[itemprop='jobLocation']")
    ),
    (
        "generic", "detail", "description",
        ("#jobDescriptionText, .jobsearch-JobComponent-description, .jobsearch-jobDescriptionText, .jobDescriptionText, .posting, .job-description",)
    ),
    (
        "generic", "detail", "salary[]",
        (
            "#jobDetailsSection [aria-label='Pay'] li", "#jobDetailsSection [aria-label='Pay'] [data-testid='list-item']",
            "#jobDetailsSection [aria-label='Pay'] span", "#salaryInfoAndJobType", "[data-testid='salaryInfoAndJobType']",
            "[data-testid='jobsearch-CollapsedEmbeddedHeader-salary']", ".salaryText", ".jobsearch-OtherJobDetailsContainer"
        )
    ),
    (
        "generic", "detail", "employment[]",
        (
            "#jobDetailsSection [aria-label='Job type'] li",
            "#jobDetailsSection [aria-label='Job type'] [data-testid='list-item']",
            "#jobDetailsSection [aria-label='Work setting'] li",
            "#jobDetailsSection [aria-label='Work setting'] [data-testid='list-item']", "[data-testid='attribute_snippet_testid']"
        )
    ),
    ("generic", "detail", "posted_at", (".date", "[data-testid='myJobsStateDate']", "time")),
)
FIELDS = (
    "raw_id", "title", "company", "location", "summary", "description", "requirements_text", "salary_text", "employment_text",
    "url", "posted_at"
)


def layouts(spark: SparkSession) -> DataFrame:
    """The layouts above as a layout table; rows of further boards can be added to it."""
    rows = [(layout, scope, field, i, x) for layout, scope, field, selectors in LAYOUTS for i, x in enumerate(selectors)]
    return spark.createDataFrame(rows, "layout string, scope string, field string, ord int, selector string")


def _joined(values: Column) -> Column:
    """Texts joined by bars, each once."""
    none = F.array().cast("array<string>")
    return F.array_join(F.array_distinct(F.filter(F.transform(F.coalesce(values, none), squeeze), lambda x: x != "")), " | ")


def _filled_in(rows: DataFrame) -> DataFrame:
    """Rows with all of FIELDS; missing ones are empty."""
    return rows.select("page_id", "pos", *[(F.coalesce(c, F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in FIELDS])


def cards(pages: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, FIELDS): the postings that list pages show, by the layout each page (page_id, url, html, layout) names.

    Of a layout's container rules the first that gives a titled card holds.  Links of generic and clearance pages
    must read like a posting.  Postings in JSON-LD come besides, after the cards (of generic pages before them).
    """
    rows = extract_layout(pages, layout or layouts(pages.sparkSession), "card").join(pages.select("page_id", F.col("url").alias("page_url"), "layout").hint("merge"), "page_id")
    kind, title, href = F.col("layout"), squeeze(F.col("title")), F.col("href")
    listed = F.lower(href).rlike("job|position|clearance") & (F.length(title) >= 3)
    rows = rows.where(
        (title != "") & (href != "") & F.when(kind == "generic", job_like(href, title)).when(kind == "clearance", listed).otherwise(True)
    )
    rows = rows.withColumn("least", F.min("rule").over(Window.partitionBy("page_id"))).where("rule = least")
    tokens = F.when(F.size("tokens[]") > 0, F.col("`tokens[]`")).when(F.size("groups[]") > 0, F.col("`groups[]`")).otherwise(F.col("`footer[]`"))
    rows = rows.withColumn("told", F.when(kind == "clearance", tokens).otherwise(F.array().cast("array<string>")))
    elsewhere = lambda t: fold(t) != fold(F.col("location"))
    posted = F.coalesce(F.get(F.filter("told", lambda t: F.startswith(fold(t), F.lit("posted"))), 0), F.lit(""))
    needs = F.concat(
        F.array("summary"),
        F.filter(
            "told",
            lambda t: (t != F.coalesce(F.get(F.filter("told", lambda x: F.startswith(fold(x), F.lit("posted"))), 0), F.lit(""))) & elsewhere(t)
        )
    )
    clear = kind == "clearance"
    found = _filled_in(rows.select(
        "page_id", "pos", F.when(kind == "indeed", F.col("raw_id")).otherwise(href).alias("raw_id"), title.alias("title"), "company", "location", "summary",
        F.when(clear, _joined(needs)).alias("requirements_text"),
        F.when(
            clear, best_salary(F.concat(F.array("summary"), F.col("told"), F.col("`salary[]`")))
        ).otherwise(best_salary(F.col("`salary[]`"), readable=False)).alias("salary_text"),
        F.when(clear, _joined(F.filter("told", lambda t: employment_fragment(t) & elsewhere(t)))).alias("employment_text"),
        absolute_url(F.col("page_url"), href).alias("url"), F.when(clear, posted).otherwise(F.col("posted_at")).alias("posted_at"),
    ))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    first = pages.select("page_id", (F.col("layout") == "generic").alias("first"))
    told = jsonld_postings(pages).withColumn("n", place).join(first.hint("merge"), "page_id")
    return found.unionByName(
        _filled_in(told.withColumn("pos", F.when(F.col("first"), F.col("n") - 1_000_000).otherwise(F.col("n") + 1_000_000).cast("int")))
    )


def details(pages: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, FIELDS): the one posting of each detail page that has a title.

    Each page is parsed once.  A clearance page is read by its layout if that gives a title; else the page's first posting in JSON-LD is taken;
    else the generic layout, with the page's title as the last resort.
    """
    url = pages.select("page_id", F.col("url").alias("page_url"))
    named = F.when(F.col("layout") == "clearance", F.array(F.lit("clearance"), F.lit("generic"))).otherwise(F.array(F.lit("generic")))
    read = extract_layouts(pages.withColumn("layouts", named), layout or layouts(pages.sparkSession), "detail").where("title <> ''").join(url.hint("merge"), "page_id")
    clear = F.col("layout") == "clearance"
    pay = F.when(clear, best_salary(F.concat("`salary[]`", F.array("description", "requirements_text")))).otherwise(best_salary(F.col("`salary[]`"), readable=False))
    apart = lambda t: (t != F.col("salary_text")) & (~clear | ((fold(t) != fold(F.col("location"))) & ~clearance_token(t) & ~placeholder(t)))
    read = read.withColumn("salary_text", pay).withColumn("employment_text", _joined(F.filter("`employment[]`", apart)))
    read = read.select(
        "page_id", F.when(clear, 0).otherwise(2).alias("way"), *[c for c in FIELDS if c in read.columns], F.col("page_url").alias("url"),
        F.col("page_url").alias("raw_id")
    )
    first = jsonld_postings(pages)
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))).where("n = 1").join(url.hint("merge"), "page_id")
    first = first.select(
        "page_id", F.lit(1).alias("way"), *[c for c in FIELDS if c in first.columns and c != "url"],
        filled(F.col("url"), F.col("page_url")).alias("url")
    )
    rows = read.unionByName(first, allowMissingColumns=True).where(~blank(F.col("title")))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("way"))).where("n = 1").withColumn("pos", F.lit(0))
    return _filled_in(best)
