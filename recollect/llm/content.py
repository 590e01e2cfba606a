"""Main text of web pages: the maximum-scoring run of words and tags."""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.batches import bounded

SAMPLE_PAGES = 500  # labelled pages that weights are learned from
MOST_FEATURES = 5_000  # of the learned weights those of the most frequent features reach the driver
SHRINK = 50.0  # words that a prior weight counts as
TAG, ASIDE = -0.5, -0.05  # prior weight of a tag; score of a tag or stretch of text inside furniture

# Fixed names. Text inside them is never running text.
RAW = "script style noscript template textarea iframe svg object select".split()
# Elements that are furniture; header and footer are not inside an article or main element.
APART = "nav menu aside form button dialog head title header footer".split()
HEADS = ("header", "footer")
# Whole words of class, id and role that are furniture, unless the element holds most of the page's words.
FURNITURE = (
    "nav navbar menu header footer aside sidebar form button notice notification alert cookie cookies consent gdpr banner "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies "
    "disqus respond breadcrumb breadcrumbs share sharing social related newsletter subscribe pagination "
    "pager toolbar popup modal login copyright legal navigation complementary contentinfo search widget dialog hidden "
    "cookie-notice cookie-banner cookie-consent site-header site-footer page-header page-footer main-nav main-menu ad-banner "
    "related-posts social-share user-comments reader-comments comment-list sign-up skip-link"
).split()
CONTENT = "article main content post entry story articlebody".split()
NEVER = ("html", "body", "main", "article")  # their classes exclude nothing
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
PLAIN = INLINE | VOID | set("html body div section p h1 h2 h3 h4 h5 h6 ul ol li table tbody thead tr td th dl dt dd blockquote pre figure figcaption center".split())
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS_P = set("p div article aside blockquote footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

QUOTED = 1 << 16  # characters that a quoted attribute may have; a quote without its fellow there is none
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_MARKED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", re.I)


class Element:
    """An element, the text directly in it left out: what marks it, and the words in it."""

    __slots__ = ("parent", "name", "marks", "words", "furniture", "article", "low", "high")

    def __init__(self, parent: "Element | None", name: str, marks: tuple[str, ...]):
        self.parent, self.name, self.marks, self.words = parent, name, marks, 0



def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name unless plain, and the whole words of class, id and role, each once."""
    found = [] if name in PLAIN else [name]
    if attributes and name not in NEVER:
        for m in _MARKED.finditer(attributes):
            found += m[1].strip("\"'").lower().split()
        if _HIDDEN.search(attributes):
            found.append("hidden")
    return tuple(dict.fromkeys(found))


def _tag_end(page: str, at: int) -> int:
    """Place behind the ``>`` that ends the tag at ``at``; -1: there is none."""
    p = at
    while (m := _STOP.search(page, p)) and m[0] != ">":
        shut = page.find(m[0], m.end(), m.end() + QUOTED)
        if shut < 0:
            m = None
            break
        p = shut + 1
    return m.end() if m else page.find(">", at) + 1 or -1


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) from one pass over the page: ``text``, ``open`` or ``close`` (value: name)."""
    at = search = 0  # text begins at ``at``
    while m := _START.search(page, search):
        i = m.start()
        if m[0] == "<!--":
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
        elif m[0][1] in "!?":
            end = page.find(">", i) + 1
        else:
            end = _tag_end(page, i)
        if end <= 0:  # no tag ends from here on
            break
        if i > at:
            yield "text", page[at:i], ""
        at = search = end
        if m[0][1] not in "!?":
            name = _NAME.match(page, i + 1)
            value = name[1].lower()
            if page[i + 1] == "/":
                yield "close", value, ""
            elif value in _CLOSE:
                shut = _CLOSE[value].search(page, end)
                at = search = shut.end() if shut else len(page)
            else:
                yield "open", value, page[name.end() : end - 1]
    if at < len(page):
        yield "text", page[at:], ""


def tokens(page: str) -> Iterator[tuple[str, str, Element, bool]]:
    """(kind, value, element, breaks the block): kind is ``tag`` (value its name, ends with a slash in front)
    or ``text`` (raw). Unclosed and wrongly nested elements are closed as far as their names allow.

    An element knows its parent only, so a page takes memory in proportion to its length.
    """
    root = Element(None, "", ())
    stack = [root]
    depth: dict[str, int] = {}  # how many open elements have a name: a lone end tag looks no further

    def drop(k: int) -> None:
        for x in stack[k:]:
            depth[x.name] -= 1
        del stack[k:]

    for kind, name, attributes in _pieces(page):
        if kind == "text":
            yield "text", name, stack[-1], False
            continue
        breaks = name not in INLINE
        if kind == "close":
            inner = stack[-1]
            if depth.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                inner = stack[k]
                drop(k)
            yield "tag", "/" + name, inner, breaks
            continue
        closes = CLOSED_BY.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if any(depth.get(x) for x in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    drop(k)
                    break
                if stack[k].name not in INLINE:
                    break
        inner = Element(stack[-1], name, _marks(name, attributes))
        if name not in VOID:
            stack.append(inner)
            depth[name] = depth.get(name, 0) + 1
        yield "tag", name, inner, breaks


PRIOR = {**{f: -4.0 for f in [*FURNITURE, *APART]}, **{f: 2.0 for f in CONTENT}}
Item = tuple[str, str, Element, bool, int]


def _read(page: str) -> tuple[list[Item], list[Element], int]:
    """Tokens with the words of each text, the elements in the order they begin, and the words of the page.

    Sets for each element the words in it and whether it is in an article or main element.
    """
    items: list[Item] = []
    elements: list[Element] = []
    for kind, value, e, breaks in tokens(page):
        n = len(value.split()) if kind == "text" else 0
        if not elements:  # what encloses all comes first
            elements.append(e)
            while elements[0].parent is not None:
                elements[0] = elements[0].parent
        if kind == "tag" and value[0] != "/":
            elements.append(e)
        e.words += n
        items.append((kind, value, e, breaks, n))
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.words += e.words
    for e in elements:
        e.article = e.name in ("article", "main") or e.parent is not None and e.parent.article
    return items, elements, elements[0].words if elements else 0


def _apart(e: Element, mark: str, total: int) -> bool:
    """Whether a mark may exclude its element: not the marks of an element that holds most of the page's words."""
    if mark == e.name and mark != "form":
        return not (mark in HEADS and e.parent is not None and e.parent.article)
    return 2 * e.words <= total


def observe(page: str) -> list[tuple[str, int, int]]:
    """(feature, words inside the labelled content, words outside) of a page that labels its own content.

    A page is labelled if it has an element of a content name; its content is the text
    there that no furniture name encloses. Tags count as features ``<name`` and ``</name``.
    """
    items, elements, total = _read(page)
    if not any(e.article for e in elements):
        return []
    known = set(FURNITURE) | set(APART)
    inside: dict[int, int] = {}
    for e in elements:
        e.furniture = e.parent is not None and e.parent.furniture or any(m in known and _apart(e, m, total) for m in e.marks)
        inside[id(e)] = 0
    out: dict[str, list[int]] = {}
    for kind, value, e, _, n in items:
        if kind == "tag":
            if not e.furniture:  # what stands in furniture says nothing of the same tag elsewhere
                out.setdefault("<" + value, [0, 0])[0 if e.article and value.strip("/") not in ("article", "main") else 1] += 1
        elif e.article and not e.furniture:
            inside[id(e)] += n
    for e in reversed(elements):
        if e.parent is not None:
            inside[id(e.parent)] += inside[id(e)]
    above: dict[int, frozenset[str]] = {}
    for e in elements:  # a mark that an enclosing element has, too, counts there
        held = above.get(id(e.parent), frozenset())
        fresh = [m for m in e.marks if m not in held]
        above[id(e)] = held.union(fresh) if fresh else held
        for m in fresh:
            x = out.setdefault(m, [0, 0])
            x[0] += inside[id(e)]
            x[1] += e.words - inside[id(e)]
    return [(k, a, b) for k, (a, b) in out.items()]


def learned(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds weights from ``sample`` labelled pages (and repeats of them), the prior weights counting as 50 words."""

    @F.pandas_udf("array<struct<f:string,a:bigint,b:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([observe(x) for x in b])

    able = pages.where(F.lower(html).rlike("<(article|main)[ >]")).select(F.col(html).alias("h"), F.xxhash64(F.lit(7), F.col(key), F.length(html)).alias("o"))
    # the hashes alone are ranked; the pages follow by a filter, exact repeats of a chosen page included
    edge = able.select("o").orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    some = able.where(F.col("o") <= F.lit(edge).cast("long"))
    # called non-deterministic so that the filter Spark infers from inline() does not run it a second time
    counts = some.select(run.asNondeterministic()("h").alias("o")).select(F.inline("o")).groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = counts.orderBy(F.desc(F.col("a") + F.col("b")), "f").limit(MOST_FEATURES).collect()
    inside = sum(r["a"] for r in rows if r["f"][0] != "<") + 1
    outside = sum(r["b"] for r in rows if r["f"][0] != "<") + 1
    weights = dict(PRIOR)
    for r in rows:
        f, a, b = r["f"], r["a"], r["b"]
        odds, n = math.log((a + 0.5) / (b + 0.5)), a + b
        if f[0] == "<":  # tags are never positive
            weights[f] = max(-6.0, min(-0.05, (TAG * SHRINK + odds * n) / (SHRINK + n)))
        else:
            odds -= math.log(inside / outside)
            weights[f] = max(-6.0, min(6.0, (PRIOR.get(f, 0.0) * SHRINK + odds * n) / (SHRINK + n)))
    return weights


def _weigh(elements: list[Element], total: int, weights: dict[str, float]) -> None:
    """The least and the greatest weight in force in each element: its own marks' and those of what encloses it."""
    for e in elements:
        e.low, e.high = (0.0, 0.0) if e.parent is None else (e.parent.low, e.parent.high)
        for m in e.marks:
            w = weights.get(m)
            if w is not None and (w > 0 or _apart(e, m, total)):
                e.low, e.high = min(e.low, w), max(e.high, w)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best contiguous run. Words of the text score their weight, tags are negative,
    and tags and stretches of text inside furniture cost little and are left out of the result."""
    best = total = 0.0
    begin = first = last = 0
    items: list[tuple[str, bool]] = []  # (text, breaks the block)
    seen, elements, words = _read(page or "")
    _weigh(elements, words, weights)
    for kind, value, e, breaks, n in seen:
        w = 1.0 + (e.low if e.low < 0 else e.high)  # of one word
        if kind == "tag":
            score = weights.get("<" + value, TAG) if w > 0 else ASIDE
            items.append(("", breaks))
        else:
            score = w * n if w > 0 else ASIDE
            items.append((_html.unescape(value) if w > 0 else "", False))
        if total <= 0:
            total, begin = 0.0, len(items) - 1
        total += score
        if total > best:
            best, first, last = total, begin, len(items)
    blocks: list[str] = []
    run: list[str] = []
    for text, breaks in [*items[first:last], ("", True)]:
        if breaks:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run = []
        elif text:
            run.append(text)
    return " ".join(blocks)


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id", weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``text``: the main text of each whole page.

    An element's name or the whole words of its class, id and role weigh against its text, a
    word of class, id or role (and ``form``) only if the element holds at most half of the
    page's words, and none on html, body, main and article. What pages teach goes before the
    prior weights.

    Defined cases: a null or empty page and one without words outside of furniture give an
    empty text; unclosed and wrongly nested markup is closed as far as names allow, in one
    pass with memory in proportion to the page; without labelled pages the prior weights are used; repeated pages give the
    same text; a column ``text`` is replaced; an empty table gives an empty result.
    """
    w = learned(pages, html, key) if weights is None else weights

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(x, w) for x in b])

    return bounded(pages).withColumn("text", run(F.col(html)))
