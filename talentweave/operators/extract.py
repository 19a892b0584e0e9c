"""Extraction from captured pages: links, structured data, details, cards, next pages; classes of links."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions.text import blank, filled, fold, squeeze, strip_html, unescape
from talentweave.functions.urls import absolute_url, board_identifier, first_segments, host, host_label, path, source_url
from talentweave.operators.annotate import salary_display
from talentweave.operators.filters import careers_path, careers_text, excluded_host
from talentweave.operators.sizes import settled

ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _attribute(attributes: Column, name: str) -> Column:
    pattern = HREF.replace("href", name)
    return unescape(filled(*[F.regexp_extract(attributes, pattern, i) for i in (1, 2, 3)]))


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, pos, href, url, text, label, aria, test_id) of every anchor with a target."""
    whole = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("a"), F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("t"))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(whole).alias("pos", "m"))
    rows = rows.select(
        "page_id", "page_url", "pos", _attribute(F.col("m.a"), "href").alias("href"), strip_html(F.col("m.t")).alias("text"),
        squeeze(F.concat_ws(" ", strip_html(F.col("m.t")), _attribute(F.col("m.a"), "aria-label"), _attribute(F.col("m.a"), "title"))).alias("label"),
        _attribute(F.col("m.a"), "aria-label").alias("aria"), _attribute(F.col("m.a"), "data-testid").alias("test_id")
    )
    return rows.where("href <> ''").withColumn("url", absolute_url(F.col("page_url"), F.col("href")))


def next_page(pages: DataFrame) -> DataFrame:
    """(page_id, next_url): a link of rel next, else an anchor marked as next, else the first that reads like next."""
    rel = r"""(?is)<(?:link|a)\b(?=[^>]*\brel\s*=\s*["']?next\b)([^>]*)>"""
    linked = pages.select(
        "page_id", F.col("url").alias("page_url"), _attribute(F.regexp_extract("html", rel, 1), "href").alias("href"),
        F.lit(0).alias("rule"), F.lit(0).alias("pos")
    )
    reads = fold(F.col("label"))
    marked = F.when(
        F.col("test_id") == "pagination-page-next", 1
    ).when(F.col("aria") == "Next", 2).when(F.col("aria") == "Next Page", 3).when(F.col("aria").contains("Next"), 4)
    rule = F.coalesce(marked, F.when(reads.isin("next", "next page", "older", "more jobs") | reads.startswith("next "), 5))
    told = extract_links(pages).withColumn("rule", rule).where("rule is not null").select("page_id", "page_url", "href", "rule", "pos")
    found = linked.where("href <> ''").unionByName(told)
    return found.groupBy("page_id").agg(F.min_by(absolute_url(F.col("page_url"), F.col("href")), F.struct("rule", "pos")).alias("next_url"))


def _variant(c: Column, where: str, kind: str = "string") -> Column:
    return F.try_variant_get(c, f"$.{where}", kind)


def jsonld_postings(pages: DataFrame) -> DataFrame:
    """Postings in JSON-LD blocks: objects, arrays, and @graph arrays; blocks that are no JSON give nothing.

    ``seq`` puts a page's postings in order.
    """
    block = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""
    rows = pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(block), 1)).alias("at", "raw")
    ).select("page_id", "url", F.array("at").alias("seq"), F.try_parse_json("raw").alias("v")).where("v is not null")

    def items(df: DataFrame, found: Column) -> DataFrame:
        rows = df.select("page_id", "url", "seq", F.posexplode(found).alias("at", "v"))
        return rows.select("page_id", "url", F.concat("seq", F.array("at")).alias("seq"), "v")

    flat = items(rows, F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")))
    graph = flat.where(F.try_variant_get("v", "$['@graph']", "array<variant>").isNotNull())
    nested = items(graph, F.try_variant_get("v", "$['@graph']", "array<variant>"))
    every = flat.unionByName(nested).where(F.lower(F.try_variant_get("v", "$['@type']", "string")) == "jobposting")
    v = F.col("v")

    def place(at: str) -> Column:
        pieces = F.concat_ws(
            ", ",
            *[F.nullif(_variant(v, f"{at}.address.{c}"), F.lit("")) for c in ("addressLocality", "addressRegion", "addressCountry")]
        )
        return F.when(
            _variant(v, f"{at}.address", "variant").isNotNull() & (pieces != ""), pieces
        ).otherwise(F.coalesce(_variant(v, f"{at}.name"), F.lit("")))

    several = F.try_variant_get(v, "$.jobLocation", "array<variant>")
    listed = F.array_join(
        F.filter(
            F.transform(
                several,
                lambda x: F.coalesce(
                    F.nullif(
                        F.concat_ws(
                            ", ",
                            *[F.nullif(F.try_variant_get(x, f"$.address.{c}", "string"), F.lit("")) for c in ("addressLocality", "addressRegion", "addressCountry")]
                        ),
                        F.lit("")
                    ),
                    F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$", "string"), F.lit("")
                )
            ),
            lambda s: s != ""
        ),
        ", "
    )
    unit = F.lower(F.coalesce(_variant(v, "baseSalary.value.unitText"), F.lit("")))
    interval = F.when(unit.contains("hour"), "hour").when(unit.contains("day"), "day").when(unit.contains("week"), "week").when(unit.contains("month"), "month").when(
        unit.contains("year") | unit.contains("annual"), "year"
    )
    low = F.coalesce(_variant(v, "baseSalary.value.minValue", "double"), _variant(v, "baseSalary.value.value", "double"))
    high = F.coalesce(_variant(v, "baseSalary.value.maxValue", "double"), _variant(v, "baseSalary.value.value", "double"))
    return every.select(
        "page_id", "seq", filled(
            _variant(v, "identifier.value"), _variant(v, "identifier"), _variant(v, "url")
        ).alias("raw_id"), _variant(v, "title").alias("title"), F.coalesce(_variant(v, "hiringOrganization.name"), F.lit("")).alias("company"),
        squeeze(
            F.when(several.isNotNull(), listed).otherwise(filled(place("jobLocation"), _variant(v, "jobLocation")))
        ).alias("location"), strip_html(_variant(v, "description")).alias("description"), absolute_url(F.col("url"), _variant(v, "url")).alias("url"),
        _variant(v, "datePosted").alias("posted_at"), _variant(v, "employmentType").alias("job_type"), F.coalesce(
            salary_display(low, high, interval, _variant(v, "baseSalary.currency")), F.lit("")
        ).alias("salary_text"),
    )


_ATTRIBUTE = re.compile(r"""\[([\w-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


@functools.cache
def _compound(selector: str) -> tuple[str, tuple[str, ...], tuple[str, ...], tuple[tuple[str, str, str], ...]]:
    """Tag, ids, classes and attribute conditions of one selector without spaces."""
    plain = _ATTRIBUTE.sub("", selector)
    tag = re.match(r"[\w-]*", plain)[0]
    return tag, tuple(re.findall(r"#([\w-]+)", plain)), tuple(re.findall(r"\.([\w-]+)", plain)), tuple(_ATTRIBUTE.findall(selector))


@functools.cache
def _chains(selector: str) -> list[list[str]]:
    """Each of a list of selectors as the chain of its compounds and ``>``."""
    return [re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", x) for x in re.split(r",\s*(?![^\[]*\])", selector)]


class _Tree(HTMLParser):
    """Elements of a page in order: tag, attributes, parent, and where their descendants and texts end."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict[str, str], int]] = [("", {}, -1)]
        self.text: list[str] = []
        self.first = [0]  # of each element's texts
        self.last: list[int | None] = [None]
        self.end: list[int | None] = [None]  # the element after its last descendant
        self.open = [0]
        self.feed(source or "")
        self.close()
        while self.open:
            self._shut()
        # where to look for a selector: elements in order by what they are, have and are called
        self.places: dict[str, list[int]] = {}
        for i, (tag, attributes, _) in enumerate(self.nodes[1:], 1):
            keys = {tag, f"#{attributes.get('id', '')}", *(f".{x}" for x in attributes.get("class", "").split()), *(f"[{k}" for k in attributes)}
            for key in keys:
                self.places.setdefault(key, []).append(i)

    def _shut(self) -> None:
        i = self.open.pop()
        self.end[i], self.last[i] = len(self.nodes), len(self.text)

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self.open[-1]))
        self.first.append(len(self.text))
        self.last.append(len(self.text))
        self.end.append(len(self.nodes))
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if any(self.nodes[i][0] == tag for i in self.open[:0:-1]):
            while self.nodes[self.open[-1]][0] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        if self.nodes[self.open[-1]][0] not in ("script", "style", "noscript", "template"):
            self.text.append(data)

    def text_of(self, top: int) -> str:
        return " ".join(" ".join(self.text[self.first[top] : self.last[top]]).split())

    def _is(self, node: int, selector: str) -> bool:
        tag, ids, classes, conditions = _compound(selector)
        name, attributes, _ = self.nodes[node]
        if (tag and name != tag) or any(attributes.get("id") != x for x in ids):
            return False
        if classes and not set(classes) <= set(attributes.get("class", "").split()):
            return False
        return all(
            k in attributes and (not how or (value in attributes[k] if how == "*=" else attributes[k] == value)) for k, how,
            value in conditions
        )

    def _matches(self, node: int, chain: list[str]) -> bool:
        """Whether the element is the last of a chain of nested selectors; ``>`` stands before a child."""
        if node <= 0 or not self._is(node, chain[-1]):
            return False
        rest = chain[:-1]
        if not rest:
            return True
        above = self.nodes[node][2]
        if rest[-1] == ">":
            return self._matches(above, rest[:-1])
        while above > 0:
            if self._matches(above, rest):
                return True
            above = self.nodes[above][2]
        return False

    def find(self, selector: str, top: int = 0) -> list[int]:
        """Elements under ``top`` of a list of selectors: tag, .class, #id, [name], [name=value], [name*=value],
        combinations of these; after a space the elements inside, after ``>`` the children."""
        found: set[int] = set()
        for chain in _chains(selector):
            tag, ids, classes, conditions = _compound(chain[-1])
            keys = [*(f"#{x}" for x in ids), *(f".{x}" for x in classes), *(f"[{k}" for k, _, _ in conditions), *([tag] if tag else [])]
            # the rarest of what the last selector asks for
            held = min((self.places.get(k, []) for k in keys), key=len) if keys else range(len(self.nodes))
            lo, hi = bisect.bisect_right(held, top), bisect.bisect_left(held, self.end[top])
            found.update(i for i in held[lo:hi] if self._matches(i, chain))
        return sorted(found)


def _value(tree: _Tree, selectors: list[str], top: int, anchor: int | None = None) -> str:
    """Text (or, after ``@name``, an attribute) of the first selector that gives one; ``a:`` stands for the card's link."""
    return next(_values(tree, selectors, top, anchor), "")


def _values(tree: _Tree, selectors: list[str], top: int, anchor: int | None = None) -> Iterator[str]:
    for selector in selectors:
        where, _, attribute = selector.partition("@")
        own = [] if anchor is None else [anchor]
        for node in own if where == "a:" else tree.find(where, top) if where else [top]:
            text = tree.nodes[node][1].get(attribute, "").strip() if attribute else tree.text_of(node)
            if text:
                yield text


def extract_layout(pages: DataFrame, layout: DataFrame, scope: str) -> DataFrame:
    """``extract_layouts`` of the one layout that each page names."""
    return extract_layouts(pages.withColumn("layouts", F.array("layout")), layout, scope).drop("layout")


def extract_layouts(pages: DataFrame, layout: DataFrame, scope: str) -> DataFrame:
    """(page_id, layout, pos, rule, fields) by a layout table (layout, scope, field, ord, selector).

    Pages (page_id, layouts, html) are parsed once and read by each of their layouts.

    ``detail`` gives one row a page; ``card`` one for each element that the field ``container`` selects, numbered in
    ``pos``, with the place of its selector in ``rule``.  A container that is a link itself is a card of what is
    around it.  A field whose name ends in ``[]`` gives all texts of all its selectors, each once.  Unknown and null
    layouts give nothing.  The table is small by nature; its size is checked before
    it goes to the tasks.
    """
    rules = layout.where(F.col("scope") == scope).orderBy("layout", "field", "ord").limit(10_001).collect()
    if len(rules) > 10_000:
        raise ValueError("a layout table has at most 10,000 rules")
    table: dict[str, dict[str, list[str]]] = {}
    for r in rules:
        table.setdefault(r["layout"], {}).setdefault(r["field"], []).append(r["selector"])
    fields = sorted({f for by in table.values() for f in by} - {"container"})

    def card(tree: _Tree, by: dict[str, list[str]], node: int | None) -> list:
        top, anchor = 0, None
        if node is not None:
            link = tree.nodes[node][0] == "a"
            anchor = node if link else next(iter(tree.find("a[href]", node)), None)
            top = tree.nodes[node][2] if link else node
        return [list(dict.fromkeys(_values(tree, by.get(f, []), top, anchor))) if f.endswith("[]") else _value(tree, by.get(f, []), top, anchor) for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, names, html in zip(batch.page_id, batch.layouts, batch.html, strict=True):
                names = [x for x in names if x in table] if names is not None else []
                tree = _Tree(html) if names else None
                for name in names:
                    by, tops = table[name], {None: 0}
                    if scope == "card":
                        tops = {}
                        for rule, selector in enumerate(by.get("container", [])):
                            for node in tree.find(selector):
                                tops.setdefault(node, rule)
                    out += [(page_id, name, pos, rule, *card(tree, by, node)) for pos, (node, rule) in enumerate(tops.items())]
            yield pd.DataFrame(out, columns=["page_id", "layout", "pos", "rule", *fields])

    kinds = "".join(f", `{f}` {'array<string>' if f.endswith('[]') else 'string'}" for f in fields)
    return pages.select("page_id", "layouts", "html").mapInPandas(run, "page_id long, layout string, pos int, rule int" + kinds)


# Link rules in order (host pattern, path pattern, platform, source type, kept path segments, priority).
LINK_RULES = (
    ("greenhouse", "", "greenhouse", "greenhouse", 1, 0),
    (r"lever\.co", "", "lever", "lever", 1, 0),
    (r"ashbyhq\.com", "", "ashby", "custom_url", 1, 1),
    (r"smartrecruiters\.com", "", "smartrecruiters", "custom_url", 1, 1),
    (r"jobvite\.com", "", "jobvite", "custom_url", 2, 1),
    (r"workdayjobs\.com", "", "workday", "custom_url", 2, 1),
    (r"bamboohr\.com", "/careers", "bamboohr", "custom_url", 1, 1),
    ("", "/careers?|/jobs|/join-?us", "careers page", "custom_url", 0, 3),
)


def classify_links(links: DataFrame, rules: tuple = LINK_RULES) -> DataFrame:
    """Links that a rule knows, with (platform, source_type, board_url, identifier, priority, name)."""
    url = source_url(F.col("url"), "custom_url")
    rows = links.withColumn("clean", url).where((host(F.col("clean")) != "") & ~excluded_host(F.col("clean")))
    clean, no = F.col("clean"), F.lit(None).cast("int")
    for i, (h, p, *_) in reversed(list(enumerate(rules))):
        hit = F.lit(True)
        hit = hit & host(clean).rlike(h) if h else hit
        hit = hit & F.lower(path(clean)).rlike(p) if p else hit
        no = F.when(hit, i).otherwise(no)
    rows = rows.withColumn("rule", no).where("rule is not null")

    def of(i: int, kind: str) -> Column:
        return F.get(F.array(*[F.lit(r[i]) for r in rules]), F.col("rule")).cast(kind)

    kept = of(4, "int")
    board = F.when(
        kept == 1,
        F.when(
            of(2, "string") == "greenhouse",
            F.concat(F.regexp_extract(clean, "^([a-z]+://[^/]*)", 1), F.lit("/"), F.coalesce(board_identifier(clean), F.lit("")))
        ).otherwise(first_segments(clean, 1))
    ).when(kept == 2, first_segments(clean, 2)).otherwise(clean)
    rows = rows.withColumns(
        {
            "platform": of(2, "string"), "source_type": of(3, "string"), "priority": of(5, "int"),
            "board_url": source_url(board, "custom_url"), "identifier": F.when(of(5, "int") == 0, board_identifier(clean))
        }
    )
    return rows.withColumn("name", host_label(F.col("board_url"))).drop("clean", "rule")


def best_candidates(candidates: DataFrame, by: list[str], limit: int = 10) -> DataFrame:
    """One candidate of each type and URL (fixed platforms, shorter reasons, first seen), then the first by priority."""
    ats = F.when(F.col("platform").isin("greenhouse", "lever"), 0).otherwise(1)
    row = F.struct(*candidates.columns)
    one = candidates.groupBy(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("source_type").alias("_t"), F.col("board_url").alias("_u")
    ).agg(F.min_by(row, F.struct(ats, F.length("reason"), "seq")).alias("_r")).select("_r.*")
    w = Window.partitionBy(*by).orderBy("priority", fold(F.col("name")), "board_url")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def walk(seeds: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """(query, page_url, depth): pages reached from seeds (query, page_url) by steps (page_url, to), and in how few of them.

    One recursive query; the depth guard ends it, also where pages lead back.  A page that is reached again at the same
    depth goes on once.
    """
    spark = seeds.sparkSession
    limit, held = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set(limit, "-1")  # the depth is what bounds it
    try:
        return settled(spark.sql(
            f"""WITH RECURSIVE reached(query, page_url, depth) AS (
                SELECT query, page_url, 0 FROM {{seeds}}
                UNION ALL
                SELECT query, to, depth + 1 FROM (
                    SELECT DISTINCT r.query, s.to, r.depth FROM reached r JOIN {{steps}} s ON r.page_url = s.page_url WHERE r.depth < {int(max_depth)}
                )
            ) SELECT query, page_url, min(depth) AS depth FROM reached GROUP BY query, page_url""",
            seeds=seeds, steps=steps
        ), "walk")
    finally:
        spark.conf.unset(limit) if held is None else spark.conf.set(limit, held)


def discover(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, per_page: int = 2) -> DataFrame:
    """Candidates from captured pages, starting at seed URLs (query, url).

    A page's links to known boards are its candidates; if it has none, its first career links are followed to their
    pages, at most ``max_depth`` times, each page once; a careers page without candidates is one itself.
    """
    clean = lambda c: source_url(c, "custom_url")
    held = pages.withColumn("page_key", clean(F.col("url")))
    # written, since links are looked up for candidates, for steps and for pages without any
    links = settled(extract_links(held.select("page_id", F.col("page_key").alias("url"), "html")), "links")
    known = classify_links(links).where("platform <> 'careers page'")
    lively = known.select("page_url").distinct()
    careers = links.where(careers_text(F.col("text")) | careers_path(F.col("url"))).withColumn("to", clean(F.col("url")))
    careers = careers.groupBy("page_url", "to").agg(F.min("pos").alias("pos"))
    first = F.row_number().over(Window.partitionBy("page_url").orderBy("pos"))
    careers = careers.withColumn("n", first).where(F.col("n") <= per_page).join(lively.hint("merge"), "page_url", "left_anti").select("page_url", "to")
    front = walk(seeds.select("query", clean(F.col("url")).alias("page_url")).distinct(), careers, max_depth)
    found = front.join(known.hint("merge"), "page_url").select(
        "query", "name", "source_type", "board_url", "platform", "identifier", "priority",
        F.concat(F.lit("Found on "), "page_url").alias("reason"), (F.col("depth") * 1_000_000 + F.col("pos")).alias("seq")
    )
    own = front.join(lively.hint("merge"), "page_url", "left_anti").where(careers_path(F.col("page_url"))).select(
        "query", host_label(F.col("page_url")).alias("name"), F.lit("custom_url").alias("source_type"),
        F.col("page_url").alias("board_url"), F.lit("careers page").alias("platform"),
        F.lit(None).cast("string").alias("identifier"), F.lit(3).alias("priority"),
        F.concat(F.lit("Careers page: "), "page_url").alias("reason"), (F.col("depth") * 1_000_000).alias("seq")
    )
    return best_candidates(found.unionByName(own), ["query"])


def to_sources(candidates: DataFrame) -> DataFrame:
    """Candidates as rows to be stored, with default limits and a note."""
    return candidates.select(
        "name", "source_type", source_url(F.col("board_url"), F.col("source_type")).alias("url"), "identifier",
        F.lit(True).alias("enabled"), F.lit(180).alias("refresh_minutes"), F.lit(3).alias("max_pages"),
        F.lit(750).alias("request_delay_ms"), F.concat_ws(": ", "platform", "reason").alias("notes")
    ).where(~blank(F.col("url")))
