"""Column functions over URLs: parts, joining, canonical forms, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.functions.text import fold, let, squeeze

# Query keys that only track, and the keys that carry or may stay on one job board's URLs.
TRACKING_KEYS = ("cf-turnstile-response", "fbclid", "gclid", "gh_src", "lever-source", "ref", "referrer", "source", "src", "tracking", "trk", "vjk")
BOARD = "indeed."
BOARD_ID_KEYS = ("jk", "currentjobid", "vjk")
BOARD_KEPT_KEYS = ("explvl", "filter", "fromage", "jt", "l", "q", "radius", "remotejob", "salarytype", "sc", "sort", "start")

_SCHEME, _HOST = r"^([A-Za-z][A-Za-z0-9+.\-]*)://", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH, _QUERY = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", r"^[^?#]*\?([^#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def parameters(url: Column) -> Column:
    """Array of (key, value) of the query in order, decoded; blank values left out."""
    pairs = F.transform(
        F.split(F.regexp_extract(url, _QUERY, 1), "&"),
        lambda p: F.struct(
            F.try_url_decode(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")
        ),
    )
    return F.filter(pairs, lambda p: p["v"].isNotNull() & (p["v"] != ""))


def query_text(pairs: Column) -> Column:
    """The pairs sorted and encoded again."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def _built(url: Column, pairs: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(path(url), "/{2,}", "/"), "/+$", "")
    query = let(query_text(pairs), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.concat(scheme(url), F.lit("://"), host(url), let(cleaned, lambda c: F.when(c == "", "/").otherwise(c)), query)


def _whole(url: Column) -> Column:
    return (scheme(url) != "") & (host(url) != "")


def _tracks(key: Column) -> Column:
    key = F.lower(key)
    return key.startswith("utm_") | key.isin(*TRACKING_KEYS)


def board_job_id(url: Column) -> Column:
    """Value of the first id key in query order, or empty."""
    found = F.filter(parameters(squeeze(url)), lambda p: F.lower(p["k"]).isin(*BOARD_ID_KEYS) & (squeeze(p["v"]) != ""))
    return F.coalesce(squeeze(F.get(found, 0)["v"]), F.lit(""))


def _board_url(url: Column, job_id: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/viewjob?jk="), F.url_encode(job_id))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no fragment, no tracking, sorted query; board URLs by job id."""

    def body(u: Column) -> Column:
        plain = _built(u, F.filter(parameters(u), lambda p: ~_tracks(p["k"])))
        board = let(board_job_id(u), lambda i: F.when(i != "", _board_url(u, i)).otherwise(plain))
        return F.when(~_whole(u), squeeze(u)).when(host(u).contains(BOARD), board).otherwise(plain)

    return let(F.coalesce(url, F.lit("")), body)


def source_url(url: Column, source_type: Column | str = "auto") -> Column:
    """A listing page's URL without tracking and challenge keys; on the board only its search keys stay."""
    kind = F.lower(F.lit(source_type) if isinstance(source_type, str) else source_type)

    def body(u: Column) -> Column:
        on_board = (kind == "indeed") | host(u).contains(BOARD)
        kept = F.filter(
            parameters(u),
            lambda p: ~_tracks(p["k"]) & ~F.lower(p["k"]).startswith("__cf_") & (~on_board | F.lower(p["k"]).isin(*BOARD_KEPT_KEYS))
        )
        return F.when(_whole(u), _built(u, kept)).otherwise(u)

    return let(squeeze(url), body)


def absolute_url(base: Column, link: Column) -> Column:
    """A link resolved against its page (null or empty: empty), with ``.`` and ``..`` steps removed."""
    return let(F.coalesce(base, F.lit("")), lambda b: let(F.coalesce(link, F.lit("")), lambda x: _resolved(b, x)))


def _resolved(base: Column, link: Column) -> Column:
    root = F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), F.lit("//"), F.regexp_extract(base, _HOST, 1))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    bare = F.regexp_replace(base, r"[?#].*$", "")
    steps = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.concat(folder, link), r"[?#].*$", ""), r"/\.(?=/|$)", "/"), "/"), lambda s: s != ".")
    walked = F.aggregate(
        steps, F.array().cast("array<string>"), lambda a,
        s: F.when(s == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, s))
    )
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    return (
        F.when(link == "", "")
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(root == "//", link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(root, F.array_join(walked, "/"), tail))
    )


def capture_url(url: Column, page_url: Column, raw_id: Column) -> Column:
    """URL of a captured row: its own, else the page's; on the board by job id or raw id."""

    def chosen(own: Column, page: Column, raw: Column) -> Column:
        def of(candidate: Column) -> Column:
            joined = F.when((page != "") & (scheme(candidate) == "") & (host(candidate) == ""), absolute_url(page, candidate)).otherwise(candidate)
            on_board = let(
                board_job_id(candidate),
                lambda i: let(
                    F.when(i != "", i).otherwise(raw),
                    lambda j: F.when(j != "", _board_url(candidate, j)).otherwise(canonical_url(candidate))
                )
            )
            return F.when(candidate == "", "").when(_whole(candidate) & host(candidate).contains(BOARD), on_board).otherwise(canonical_url(joined))

        bare_board = (own == "") & _whole(page) & (raw != "") & host(page).contains(BOARD)
        return F.when(bare_board, _board_url(page, raw)).otherwise(let(F.when(own != "", own).otherwise(page), of))

    return let(squeeze(url), lambda o: let(squeeze(page_url), lambda p: let(squeeze(raw_id), lambda r: chosen(o, p, r))))


def posting_key(title: Column, company: Column, location: Column, url: Column, job_type: Column) -> Column:
    """``url:`` and the canonical URL, or ``title:`` and the folded fields."""
    named = F.concat(F.lit("title:"), F.concat_ws("|", *[fold(squeeze(c)) for c in (title, company, location, job_type)]))
    return let(canonical_url(url), lambda u: F.when(u != "", F.concat(F.lit("url:"), u)).otherwise(named))


# Parts of a URL that name a source type.
SOURCE_PARTS = (("greenhouse", "greenhouse"), ("lever.co", "lever"), ("indeed.", "indeed"), ("clearance", "clearance"))


def source_type(given: Column, url: Column) -> Column:
    """The given type, or for ``auto`` (and null) the type that the URL tells."""
    kind = F.coalesce(given, F.lit("auto"))
    told = F.lit("custom_url")
    for part, name in reversed(SOURCE_PARTS):
        told = F.when(F.lower(url).contains(part), name).otherwise(told)
    return F.when(kind == "auto", told).otherwise(kind)


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def first_segments(url: Column, n: int) -> Column:
    """Scheme, host and the first path segments only."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"), F.array_join(F.slice(segments(url), 1, n), "/"))


def board_identifier(url: Column) -> Column:
    """The board's name: the first path segment, or the second after a generic first one; null without path."""
    parts = segments(url)
    generic = F.get(parts, 0).isin("boards", "job-boards", "embed", "jobapp") & (F.size(parts) > 1)
    return F.when(generic, F.get(parts, 1)).otherwise(F.get(parts, 0))


def host_label(url: Column, generic: tuple[str, ...] = ("www", "jobs", "boards", "careers")) -> Column:
    """A readable name: the host's first label that is not generic, capitalised."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: ~x.isin("", *generic))
    return F.when(F.size(labels) > 0, F.initcap(F.replace(F.get(labels, 0), F.lit("-"), F.lit(" ")))).otherwise(host(url))


def unwrap_redirect(url: Column, key: str = "uddg") -> Column:
    """Target of a search engine's redirect link, else the link."""
    found = F.filter(parameters(F.coalesce(url, F.lit(""))), lambda p: p["k"] == key)
    return F.when(F.size(found) > 0, F.get(found, 0)["v"]).otherwise(F.coalesce(url, F.lit("")))


def next_page_url(url: Column, current: Column, last: Column, key: str = "page", step: int = 1) -> Column:
    """The URL of the page after ``current``, or null beyond ``last``."""
    others = F.filter(parameters(url), lambda p: p["k"] != key)
    one = F.array(F.struct(F.lit(key).alias("k"), (current + step).cast("string").alias("v")))
    return F.when(current < last, _built(url, F.concat(others, one)))
