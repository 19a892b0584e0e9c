"""Column functions over text: white space, folding, markup, hashes, excerpts, lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of script remains in captured descriptions, and how many make a text noise.
SCRIPT_NOISE = r"(?i)(sourceMappingURL|window\.__|window\.onerror|webpack|rspack|bundler=|pixelRatio|screenWidth|screenHeight|function\s*\(|var\s+\w+\s*=\s*\{)"
SCRIPT_NOISE_HITS, SCRIPT_NOISE_CHARS = 2, 1200
# The named character references decoded besides numeric ones.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–",
    "&mdash;": "—", "&hellip;": "…", "&rsquo;": "’", "&amp;": "&"
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Without it each mention repeats the whole expression in the plan, and nested functions multiply it.
    """
    return F.get(F.transform(F.array(value), body), 0)


def squeeze(c: Column) -> Column:
    """Null becomes empty; every run of white space (any Unicode kind) one space; ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Case folding for comparison."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _numbered(c: Column) -> Column:
    """Numeric character references as characters; those of no character stay."""

    def decoded(piece: Column) -> Column:
        plain, hexed = F.regexp_extract(piece, r"^&#([0-9]{1,7});", 1), F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(plain).try_cast("int")
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(fine, F.concat(sign, F.regexp_replace(piece, "^&#[xX]?[0-9a-fA-F]+;", ""))).otherwise(piece)

    return let(c, lambda t: F.when(t.contains("&#"), F.array_join(F.transform(F.split(t, "(?=&#)"), decoded), "")).otherwise(t))


def unescape(c: Column) -> Column:
    """Character references, numeric ones and those of ENTITIES; the ampersand last, so nothing is decoded twice."""
    c = _numbered(c)
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Text of a markup string: comments, scripts, styles and tags go, references are decoded."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "template"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return squeeze(unescape(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


def drop_noise(c: Column) -> Column:
    """Empty where the beginning of the text looks like script code."""
    head = F.substring(c, 1, SCRIPT_NOISE_CHARS)
    return F.when(F.regexp_count(head, F.lit(SCRIPT_NOISE)) >= SCRIPT_NOISE_HITS, "").otherwise(c)


def clean_text(c: Column) -> Column:
    """Markup stripped if there seems to be any, then script noise dropped."""
    plain = let(F.coalesce(c, F.lit("")), lambda t: F.when(t.contains("<") & t.contains(">"), strip_html(t)).otherwise(squeeze(t)))
    return let(plain, drop_noise)


def text_hash(c: Column) -> Column:
    return F.sha2(squeeze(c), 256)


def excerpt(c: Column, limit: int = 240) -> Column:
    return let(squeeze(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))))


def blank(c: Column) -> Column:
    """True for null and empty."""
    return F.coalesce(c, F.lit("")) == ""


def filled(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.when(~blank(c), c) for c in cs], F.lit(""))


def lines(*cs: Column) -> Column:
    """The non-empty ones joined by newlines."""
    return F.concat_ws("\n", *[F.when(~blank(c), c) for c in cs])


def distinct_folded(values: Column) -> Column:
    """White space squeezed, empties dropped, the first spelling of equal values kept, order kept."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), squeeze), lambda x: x != "")
    return let(clean, lambda v: let(F.transform(v, fold), lambda keys: F.filter(v, lambda x, i: F.array_position(keys, fold(x)) == i + 1)))


def distinct_sorted(values: Column) -> Column:
    """As ``distinct_folded``, sorted by folded value, then by value."""
    pairs = F.transform(distinct_folded(values), lambda x: F.struct(fold(x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def joined_distinct(*cs: Column, by: str = " | ") -> Column:
    """Fragments joined once each."""
    return F.array_join(distinct_folded(F.array(*cs)), by)


def section_after(text: Column, header: str) -> Column:
    """What follows the first match of a header pattern (without groups), or empty."""
    return squeeze(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is){header}(.*)$", 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, within 0 and 1; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


# Contact patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,2}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}"
LINK = r"https?://[^\s|,;]+"


def first_match(c: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"({pattern})", 1), F.lit(""))
