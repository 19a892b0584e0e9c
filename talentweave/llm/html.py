"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every text of a page is a node with two states, content or not.  Each node has a potential from
what it is (tag, words in its class, id and role, lengths, share of links, forms); each parent and child share a
potential by the kind of child.  Sum-product messages go from the leaves to the root and back, all pages of a slice
at once, level by level, and give every node's marginal.  The potentials are fitted by gradient ascent on the
likelihood of labelled pages (``labelled``), with the expectations from the same messages.
"""

from __future__ import annotations

import bisect
import html as entities
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talentweave.llm.common import map_slices, only

TAGS = (
    "#text html body div span p a ul ol li nav header footer aside article main section h1 h2 h3 h4 table tr td th tbody form input button select textarea label"
    " b strong i em br img figure figcaption blockquote pre code dl dt dd hr address details summary fieldset iframe small time"
).split()
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr #text".split()
)
#: Never text of a page: their contents are skipped.
HIDDEN = frozenset("script style noscript template head title iframe object svg math".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: A start tag of the key ends an open element of the value, up to the nearest list or table.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}
}
_HOLDS = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"},
    "option": {"select"}, "body": set()
}
_P_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Words in class, id and role attributes, by what they usually mark.
HINTS = [re.compile(x) for x in (
    r"nav|menu|breadcrumb|pagination|pager|toc", r"header|masthead|topbar|toolbar|branding", r"foot|copyright|legal", r"side|aside|widget|related|recommend|trending|rail|more-",
    r"comment|repl(y|ies)|discuss|respon(d|se)|disqus", r"\bads?\b|\bad-|-ad\b|advert|sponsor|promo|banner|teaser", r"cookie|consent|notice|alert|popup|modal|newsletter|subscri|gdpr|toast|overlay",
    r"form|search|login|signup|signin|register", r"share|social|follow", r"article|post|entry|story|main|content|prose|text|body",
)]
#: Comments, other declarations, tags with well-formed attributes (nothing is tried twice), any other tag.
_ATTRIBUTES = r"""(?:\s++|/|[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S
)
_MARKS = re.compile(
    r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)|(\shidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)",
    re.I
)


@dataclass
class Page:
    """One page's nodes in order: parent, tag, hint bits, text (of text nodes), and the block each text is in."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


_HINT_BITS: dict[str, int] = {}


def _hints(attributes: str) -> int:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    found = _HINT_BITS.get(attributes)
    if found is None:
        bits = 0
        for value, hidden in _MARKS.findall(attributes):
            low = value.lower()
            bits |= sum(1 << i for i, p in enumerate(HINTS) if p.search(low)) | (bool(hidden) << len(HINTS))
        found = bits
        if len(_HINT_BITS) < 20_000:
            _HINT_BITS[attributes] = bits
    return found


def parse(source: str) -> Page:
    """The page's tree, with ends that the source leaves out; comments, scripts and the like make no nodes."""
    page = Page()
    stack, names = [-1], [""]
    places: dict[str, list[int]] = {}  # where in the stack each name stands, so that nothing is searched for
    block, at = 0, 0

    def push(number: int, name: str) -> None:
        places.setdefault(name, []).append(len(names))
        stack.append(number)
        names.append(name)

    def cut(back: int) -> None:
        """Close the open elements from a place of the stack on."""
        for name in names[back:]:
            places[name].pop()
        del names[back:], stack[back:]

    def last(*wanted: str) -> int:
        return max((places[x][-1] for x in wanted if places.get(x)), default=-1)

    def node(tag: str, hints: int, text: str | None) -> int:
        page.parent.append(stack[-1])
        page.tag.append(TAG_NUMBER.get(tag, len(TAGS)))
        page.hints.append(hints)
        page.text.append(text)
        page.block.append(block)
        page.label.append(0)
        return len(page.parent) - 1

    def say(raw: str) -> None:
        if raw and (raw.strip() or page.text):
            node("#text", 0, entities.unescape(raw) if "&" in raw else raw)

    node("html", 0, None)
    stack, names = [], []
    push(0, "html")
    hidden = 0  # depth of the stack at which hidden content began
    end, n = 0, len(source)
    while end < n:
        m = _TOKEN.search(source, end)
        if not m:
            if not hidden:
                say(source[end:])
            break
        at = m.start()
        if at > end and not hidden:
            say(source[end:at])
        end = m.end()
        name = m[2] or m[5]
        if not name:
            if source.startswith("<![CDATA[", at) and not hidden:
                say(source[at + 9 : end - 3])
            continue
        name = name.lower()
        closing = (m[1] or m[4]) == "/"
        if name not in INLINE:
            block += 1
        if closing:
            back = last(name)
            if back >= 0:
                cut(max(back, 1))
                if hidden and len(stack) < hidden:
                    hidden = 0
            continue
        if name == "html":
            page.hints[0] |= _hints(m[3] or "")
            continue
        if name == "br":
            if not hidden:
                say("\n")
            continue
        if not hidden or name == "body":
            if name in _P_ENDS and last("p") > last("table", "button", "object"):
                cut(last("p"))
            ends = _CLOSES.get(name)
            if ends:
                # up to the nearest holder, but never the root
                inside = last(*_HOLDS[name]) if _HOLDS[name] else 0
                firsts = [x[i] for x in map(places.get, ends) if x and (i := bisect.bisect_right(x, max(inside, 0))) < len(x)]
                if firsts:
                    cut(min(firsts))
                if hidden and len(stack) < hidden:
                    hidden = 0
        if name in RAW and (m[3] or "").rstrip()[-1:] != "/":
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, end)
            if name == "textarea" and not hidden:
                own = node(name, _hints(m[3] or ""), None)
                stack.append(own)
                say(source[end : close.start() if close else n])
                stack.pop()
            end = close.end() if close else n
            continue
        if name in VOID:
            if not hidden:
                node(name, _hints(m[3] or ""), None)
            continue
        if name == "body" and places.get("body"):
            continue
        push(node(name, _hints(m[3] or ""), None) if not hidden else stack[-1], name)
        if name in HIDDEN and not hidden:
            hidden = len(stack)
    return page


#: Features of a node: tags, hints, hints of an ancestor, then numbers.
N_TAG, N_HINT = len(TAGS) + 1, len(HINTS) + 1
_NUMBERS = 22
WIDTH = N_TAG + 2 * N_HINT + N_TAG + _NUMBERS
KINDS = 5  # of a parent and child: text, inline, block, boundary tags, text beside blocks


@dataclass
class Forest:
    """All nodes of several pages, with levels by depth for the messages."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    x: np.ndarray
    first: np.ndarray


#: The last of HINTS: what usually holds a page's content.
_CONTENT_HINT = len(HINTS) - 1
_SECTION = np.array([t in ("nav", "header", "footer", "aside", "form", "article", "main", "section") for t in TAGS] + [False])
_INLINE_TAG = np.array([t in INLINE for t in TAGS] + [False])


def forest(pages: list[Page]) -> Forest:
    sizes = np.fromiter((len(p.parent) for p in pages), np.int64, len(pages))
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    parent = np.fromiter((q + f if q >= 0 else -1 for p, f in zip(pages, first.tolist(), strict=True) for q in p.parent), np.int64, n)
    tag = np.fromiter((t for p in pages for t in p.tag), np.int64, n)
    hints = np.fromiter((h for p in pages for h in p.hints), np.int64, n)
    texts = [t for p in pages for t in p.text]
    chars = np.fromiter((0 if t is None else len(t.strip()) for t in texts), np.float64, n)
    commas = np.fromiter((0 if t is None else t.count(",") + t.count(".") + t.count("?") + t.count(";") for t in texts), np.float64, n)
    depth = np.zeros(n, np.int64)
    levels = [np.flatnonzero(parent < 0)]
    order = np.argsort(parent, kind="stable")
    sorted_parent = parent[order]
    while True:
        lo, hi = np.searchsorted(sorted_parent, levels[-1], "left"), np.searchsorted(sorted_parent, levels[-1], "right")
        total = int((hi - lo).sum())
        if not total:
            break
        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(total)
        levels.append(np.sort(order[at]))
        depth[levels[-1]] = len(levels) - 1
    # sums over subtrees, leaves first; what an ancestor says, roots first
    in_link = (tag == TAG_NUMBER["a"]).astype(np.int64)
    inside = np.isin(tag, [TAG_NUMBER["article"], TAG_NUMBER["main"]]) | (hints >> _CONTENT_HINT & 1 > 0) & ~_INLINE_TAG[tag] & (tag > TAG_NUMBER["body"])
    aside = (hints & ((1 << _CONTENT_HINT) - 1) > 0) | np.isin(tag, [TAG_NUMBER[t] for t in ("nav", "aside", "footer", "form")])
    above = np.zeros(n, np.int64)
    section = np.where(_SECTION[tag], tag, len(TAGS))
    for level in levels[1:]:
        q = parent[level]
        in_link[level] |= in_link[q]
        aside[level] |= aside[q]
        inside[level] = (inside[level] | inside[q]) & ~aside[level]
        above[level] = above[q] | hints[q]
        section[level] = np.where(_SECTION[tag[q]], tag[q], section[q])
    page_of = np.repeat(np.arange(len(pages)), sizes)
    named = np.bincount(page_of[inside], minlength=len(pages))[page_of] > 0  # whether the page names a container of its content
    link = chars * in_link
    total, marks, linked, forms, leaves = chars.copy(), commas.copy(), link.copy(), np.isin(
        tag, [TAG_NUMBER[x] for x in ("input", "button", "select", "textarea", "form")]
    ).astype(float), (chars > 0).astype(float)
    for level in levels[:0:-1]:
        for sums in (total, marks, linked, forms, leaves):
            np.add.at(sums, parent[level], sums[level])
    whole = np.repeat(total[first], sizes) if n else total
    x = np.zeros((n, WIDTH), np.float32)
    rows = np.arange(n)
    x[rows, tag] = 1
    for b in range(N_HINT):
        x[:, N_TAG + b] = hints >> b & 1
        x[:, N_TAG + N_HINT + b] = above >> b & 1
    x[rows, N_TAG + 2 * N_HINT + section] = 1
    q = np.maximum(parent, 0)
    base = N_TAG + 2 * N_HINT + N_TAG
    density = linked / np.maximum(total, 1)
    numbers = (
        np.ones(n), np.log1p(total) / 5, density, (density > 0.6), marks / np.maximum(total, 1) * 20,
        total / np.maximum(whole, 1), forms > 0, np.minimum(depth, 12) / 6, total > 80, total > 250, total == 0,
        np.log1p(leaves) / 3, density[q], np.log1p(total[q]) / 5, inside, named & ~inside, ~named, ~named & (total > 40) & (density < 0.5),
        (tag == 0) * np.log1p(total) / 5, (tag == 0) & (total > 80), (tag == 0) & ~named & (in_link == 0), (in_link > 0) & ~inside
    )
    for i, v in enumerate(numbers):
        x[:, base + i] = v
    kind = np.where(tag == 0, 0, np.where(_SECTION[tag], 3, np.where(_INLINE_TAG[tag], 1, 2)))
    blocks = np.zeros(n, bool)  # elements that hold blocks; text beside these is told apart from text in a paragraph
    blocks[q[kind >= 2]] = True
    blocks[np.isin(tag, [TAG_NUMBER["html"], TAG_NUMBER["body"]])] = True
    kind = np.where((kind < 2) & blocks[q] & (parent >= 0), 4, kind)
    return Forest(parent, kind, levels, x, first)


def _sum_of(a: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum over the two states on an axis."""
    return np.logaddexp(*np.moveaxis(a, axis, 0))


def messages(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product on all trees: node marginals (n, 2), edge marginals (n, 2, 2) of parent and node, log partition."""
    n = len(f.parent)
    up = unary.copy()  # a node's own potential and what its children said
    sent = np.zeros((n, 2))
    for above, level in zip(f.levels[-2::-1], f.levels[:0:-1], strict=True):
        sent[level] = _sum_of(pair[f.kind[level]] + up[level][:, None, :], 2)
        at = np.searchsorted(above, f.parent[level])  # work by the level's size, so deep pages stay linear
        for s in (0, 1):
            up[above, s] += np.bincount(at, weights=sent[level, s], minlength=len(above))
    down = np.zeros((n, 2))
    edges = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = up[f.parent[level]] + down[f.parent[level]] - sent[level]
        joint = rest[:, :, None] + pair[f.kind[level]]
        down[level] = _sum_of(joint, 1)
        joint = (joint + up[level][:, None, :]).reshape(-1, 4)
        a, b, c, d = joint.T
        joint = np.exp(joint - np.maximum(np.maximum(a, b), np.maximum(c, d))[:, None])
        a, b, c, d = joint.T
        edges[level] = (joint / (a + b + c + d)[:, None]).reshape(-1, 2, 2)
    belief = up + down
    log_z = _sum_of(up[f.levels[0]], 1)
    content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
    return np.stack([1 - content, content], axis=1), edges, log_z


@dataclass
class Model:
    weights: np.ndarray  # of content against not, by feature
    pair: np.ndarray  # (KINDS, parent's state, child's state)

    def marginals(self, pages: list[Page]) -> np.ndarray:
        f = forest(pages)
        unary = np.zeros((len(f.parent), 2))
        unary[:, 1] = f.x @ self.weights
        return messages(f, unary, self.pair)[0][:, 1]


def fit(pages: list[Page], rounds: int = 150, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Potentials of the greatest penalised likelihood of the pages' labels, by adaptive gradient steps."""
    f = forest(pages)
    y = np.array([v for p in pages for v in p.label])
    weights, pair = np.zeros(WIDTH), np.zeros((KINDS, 2, 2))
    x, child = np.asfortranarray(f.x), np.flatnonzero(f.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    of_kind = [child[f.kind[child] == k] for k in range(KINDS)]
    grown_w, grown_p = np.full(WIDTH, 1e-8), np.full(pair.shape, 1e-8)
    n = len(y)
    for _ in range(rounds):
        unary = np.zeros((n, 2))
        unary[:, 1] = x @ weights.astype(np.float32)
        p, edges, _ = messages(f, unary, pair)
        g = x.T @ (y - p[:, 1]).astype(np.float32) / n - decay * weights
        expected = np.stack([edges[of].sum(0) for of in of_kind])
        gp = (seen - expected) / n - decay * pair
        grown_w += g * g
        grown_p += gp * gp
        weights += rate * g / np.sqrt(grown_w)
        pair += rate * gp / np.sqrt(grown_p)
    return Model(weights, pair)


def main_text(page: Page, content: np.ndarray, at_least: float = 0.5) -> str:
    """The content texts in order: white space inside a block as one space, blocks joined by one space."""
    out, last = [], None
    for text, block, p in zip(page.text, page.block, content.tolist(), strict=True):
        if text is None or p < at_least:
            continue
        if block != last:
            out.append(" ")
            last = block
        out.append(text)
    return " ".join("".join(out).split())


def labelled(n: int = 400, seed: int = 5) -> list[Page]:
    """Labelled pages to learn from: articles among all usual kinds of surroundings, drawn at random.

    The marks \\x01 and \\x02 in the drawn source say whether a text is content; they are read off and removed.
    """
    r = random.Random(seed)
    syllables = "an be co da en fi ga he in ja ko le mi no os pe qua re si ta un ve wo xi ya zu st tion ch ent".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def sentence() -> str:
        return words(3, 16).capitalize().replace(" ", ", ", r.random() < 0.3) + "."

    def prose(lo: int, hi: int, mark: str) -> str:
        body = " ".join(sentence() for _ in range(r.randint(lo, hi)))
        if r.random() < 0.3:
            a, _, b = body.partition(" ")
            kind = r.choice(["a href='/x'", "b", "em", "strong", "span"])
            return f"{mark}{a} <{kind}>{mark}{word()}</{kind.split()[0]}> {mark}{b}"
        return mark + body

    def wrap(tags: list[str], names: list[str], body: str) -> str:
        tag = r.choice(tags)
        attribute = f" {r.choice(['class', 'id'])}='{r.choice(names)}'" if names and (tag in ("div", "section", "p", "ol", "li", "article") or r.random() < 0.5) else ""
        return f"<{tag}{attribute}>{body}</{tag}>"

    def links(lo: int, hi: int) -> str:
        items = [f"<a href='/{word()}'>\x02{words(1, 3)}</a>" for _ in range(r.randint(lo, hi))]
        return r.choice(
            [
                lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items),
                lambda: "".join(f"<div>{x}</div>" for x in items)
            ]
        )()

    def nav() -> str:
        return wrap(["nav", "nav", "div", "header"], ["nav", "menu", "main-menu", "breadcrumbs", "navbar"], links(2, 9))

    def head() -> str:
        return wrap(
            ["header", "header", "div"], ["header", "masthead", "topbar", "site-header"],
            r.choice(
                [f"<h2>\x02{words(1, 3)}</h2>", f"<p>\x02{words(1, 6)}</p>", f"<a href='/'>\x02{words(1, 2)}</a>", f"<div>\x02{sentence()}</div>"]
            ) + (links(1, 6) if r.random() < 0.5 else "")
        )

    def foot() -> str:
        return wrap(
            ["footer", "footer", "div"], ["footer", "site-footer", "copyright"],
            f"\x02&copy; {words(1, 3)} &middot; {sentence() * r.randint(1, 3)}" + (links(1, 6) if r.random() < 0.4 else "")
        )

    def advert() -> str:
        return wrap(
            ["div", "div", "aside", "section", "p"], ["ad", "ads", "advert", "sponsored", "promo", "ad-box", "banner"],
            r.choice([f"\x02{sentence()}", f"<p>{prose(1, 3, chr(2))}</p>", f"<a href='/buy'>\x02{words(2, 9)}</a>"])
        )

    def notice() -> str:
        return wrap(
            ["div", "div", "section", "aside"],
            ["cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "gdpr-banner"],
            f"<p>{prose(1, 3, chr(2))}</p>" + (f"<button>\x02{word()}</button>" if r.random() < 0.7 else "")
        )

    def sidebar() -> str:
        body = f"<h3>\x02{words(1, 3)}</h3>" + r.choice([lambda: links(2, 8), lambda: f"<p>{prose(1, 4, chr(2))}</p>"])()
        return wrap(["aside", "aside", "div"], ["sidebar", "related", "widget", "side-rail", "trending", "recommended"], body * r.randint(1, 2))

    def form() -> str:
        body = "".join(
            f"<label>\x02{words(1, 3)}</label><input name='{word()}'>" for _ in range(r.randint(1, 4))
        ) + f"<button>\x02{words(1, 2)}</button>"
        body += f"<p>\x02{sentence()}</p>" if r.random() < 0.4 else ""
        body += f"<select><option>\x02{word()}<option>\x02{word()}</select>" if r.random() < 0.2 else ""
        body += f"<textarea>\x02{words(1, 5)}</textarea>" if r.random() < 0.2 else ""
        return wrap(["form", "form", "form"], ["search", "login", "signup", "contact-form"], body)

    def comments() -> str:
        one = lambda: wrap(
            ["div", "li", "article"], ["comment", "reply", "comment-body"], f"<b>\x02{word()}</b> <p>{prose(1, 5, chr(2))}</p>"
        )
        return wrap(
            ["section", "div", "ol", "aside"], ["comments", "comment-list", "discussion", "responses", "replies"],
            f"<h3>\x02{words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))) + (form() if r.random() < 0.3 else "")
        )

    def linked(mark: str) -> str:
        """A sentence in which some words are links."""
        return " ".join(f"<a href='/{word()}'>{mark}{words(1, 4)}</a>{mark}," if r.random() < 0.4 else mark + words(1, 5) for _ in range(r.randint(2, 6))) + "."

    def loose() -> str:
        """Prose between line breaks, without elements of its own."""
        return "<br><br>".join(prose(1, 4, chr(1)) for _ in range(r.randint(1, 5)))

    def article() -> tuple[str, bool]:
        """An article, and whether it has a container that is named."""
        title = f"<h1>\x01{words(1, 10)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}" + (f"<p>{prose(1, 2, chr(1))}</p>" if r.random() < 0.5 else "") + "</header>"
        parts = [title] if r.random() < 0.85 else []
        layout = r.choices(["named", "bare", "div", "table", "loose"], [10, 3, 2, 3, 1.5])[0]
        if layout == "loose":
            body = "".join(parts) + loose()
            return r.choice([body, body, f"<div>{body}</div>", f"<table><tr><td>{links(1, 8)}</td><td>{body}</td></tr></table>"]), False
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            parts.append(r.choices([
                lambda: f"<p>{prose(1, 7, chr(1))}" + r.choice(["</p>", "</p>", "</p>", ""]),
                lambda: f"<p><b>{prose(1, 3, chr(1))}<br>",
                lambda: f"<h2>\x01{words(1, 5)}</h2>",
                lambda: "<ul>" + "".join(f"<li>\x01{words(1, 14)}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 5))) + "</ul>",
                lambda: f"<blockquote>{r.choice(['<p>', ''])}{prose(1, 2, chr(1))}</blockquote>",
                lambda: f"<table><tr><td>\x01{words(1, 3)}</td><td>\x01{words(1, 5)}</td></tr></table>",
                lambda: f"<pre><code>\x01{words(2, 12)}</code></pre>",
                lambda: f"<figure><img src='x'><figcaption>\x01{words(2, 8)}</figcaption></figure>",
                lambda: f"<div>{prose(1, 5, chr(1))}</div>",
                lambda: f"<section><h3>\x01{words(1, 4)}</h3><p>{prose(1, 4, chr(1))}</p></section>",
                lambda: f"<p>{linked(chr(1))}</p>",
                lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>\x01{words(1, 6)}</a></li>" for _ in range(r.randint(1, 5))) + "</ul>" if layout == "named" else f"<p>{prose(1, 7, chr(1))}</p>",
                lambda: f"<p>\x01{words(1, 3)}.</p>",
            ], [12, 2, 2, 2, 1, 1, 1, 1, 1.5, 1, 1.5, 1, 1])[0]())
            if r.random() < 0.06 and layout == "named":
                parts.append(r.choice([advert, notice, form, sidebar])())
        if layout != "named":
            if len(parts) < 2:
                parts.append(f"<p>{prose(1, 7, chr(1))}</p>")
            body = "".join(parts)
            if layout == "table":
                side = f"<td>{links(1, r.choice([1, 2, 8]))}</td>" if r.random() < 0.8 else ""
                return f"<table><tr>{side}<td>{body}</td></tr></table>", False
            return (body if layout == "bare" else f"<div>{body}</div>"), False
        tag = r.choice(["article"] * 5 + ["main", "div", "section"])
        name = f" class='{r.choice(['article', 'post', 'entry-content', 'story', 'content', 'main-text'])}'" if tag in ("div", "section") or r.random() < 0.2 else ""
        return f"<{tag}{name}>{''.join(parts)}</{tag}>", True

    pages = []
    for _ in range(n):
        before = [f() for f in (nav, head, advert, notice, form, sidebar) if r.random() < (0.75 if f is nav else 0.3)]
        after = [f() for f in (sidebar, comments, advert, form, notice, nav) if r.random() < 0.3] + ([foot()] if r.random() < 0.9 else [])
        r.shuffle(before)
        middle, is_named = article()
        if not is_named and r.random() < 0.25:
            before, after = [], []
        if is_named and r.random() < 0.3:
            middle = f"<div class='{r.choice(['wrapper', 'page', 'container', 'content', 'main'])}'>{middle + (after.pop(0) if after else '')}</div>"
        if is_named and r.random() < 0.25:
            middle = f"<main>{middle}</main>"
        page = parse(f"<html><head><title>{word()}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>")
        _read_labels(page)
        pages.append(page)
    return pages


def _read_labels(page: Page) -> None:
    """Texts by their marks; an element is content if it has text and all of it is."""
    n = len(page.parent)
    good, bad = [0] * n, [0] * n
    for i, t in enumerate(page.text):
        if t is not None:
            good[i], bad[i] = "\x01" in t, "\x02" in t
            if not good[i] and not bad[i]:  # white space or the rest of a marked text: as its neighbours
                good[i] = int(bool(good[page.parent[i]]))
            page.text[i] = t.replace("\x01", "").replace("\x02", "")
    total_good, total_bad = list(map(int, good)), list(map(int, bad))
    for i in range(n - 1, 0, -1):
        total_good[page.parent[i]] += total_good[i]
        total_bad[page.parent[i]] += total_bad[i]
    # the page itself is never content, so its parts don't speak for each other
    whole = TAG_NUMBER["html"], TAG_NUMBER["body"]
    page.label = [int(total_good[i] > 0 and total_bad[i] == 0 and page.tag[i] not in whole) for i in range(n)]
    for i in range(n):  # an element or text without marks goes with its parent
        if not total_good[i] and not total_bad[i] and page.parent[i] >= 0:
            page.label[i] = page.label[page.parent[i]]


_MODEL: list[Model] = []


def default_model() -> Model:
    """Fitted once in a process from the drawn pages; the same each time."""
    if not _MODEL:
        _MODEL.append(fit(labelled()))
    return _MODEL[0]


def extract(pages: DataFrame, model: Model | None = None, at_least: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the whole page's main text, empty if it has none.

    Null and empty html give empty text; very long pages are read whole; repeated rows give equal rows; null ids
    and urls stay null; an empty table gives no rows.  Only the three named columns are read.
    """
    model = model or default_model()

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        parsed = [parse(x.decode()) for x in texts]
        p = model.marginals(parsed)
        out, at = [], 0
        for page in parsed:
            out.append(main_text(page, p[at : at + len(page.parent)], at_least))
            at += len(page.parent)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
            ["page_id", "url", "text", "n_chars"]
        )

    return map_slices(only(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", text="html")
