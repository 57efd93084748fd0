"""Operator 8: main text of web pages by tree scoring.

A page is read once into a light tree (unclosed and overlapping tags are
tolerated, raw elements such as scripts are skipped whole). Every block of text
gives points to the containers above it: one, one for each comma, and up to
three for length, times the share of its letters outside links; all to the
parent, half to the grandparent, less further up; an ``article`` element starts with some.
The container with most points, discounted by its share of letters in links, is the
main text, or the nearest ``article`` around it; siblings with enough points, plain
sibling paragraphs and a top heading are kept with it. Parts that say what they are
by tag, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
comments, hidden parts) give no points and no text. A form, class or id takes no part
away that lies around half or more of the text within ``article``/``main`` elements,
or, on a page without these, holds most of the points of the page. A word that also
has other uses (header, social, notice) counts only beside words of layout. Lists of
links within the article are kept.

Null and empty html give the empty text, and so does a page without text. Long pages
are read to their end. Of containers with equally many points the first counts. Each
page is handled alone, in one map without a shuffle; repeated rows give repeated
results, and an empty table an empty one. ``keep`` may name any columns of the table
but text and n_chars, which are made here; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|select|option|xmp)\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br nobr picture source input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP_TAGS = frozenset("nav footer aside button dialog menu head fieldset audio video canvas map".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that name an unwanted part; those that do so only beside words of layout; and these.
_DROP_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr popup modal newsletter login signup sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus pager pagination paywall share sharing banner promo promotion overlay subscribe subscription reply replies respond related recommended recommendations widget widgets toolbar notices alerts".split())
_WEAK_NAMES = frozenset("header side social notice alert hidden skip".split())
_LAYOUT = frozenset("site page global top bottom left right main bar box list lists link links icon icons button buttons wrapper container wrap inner outer block area panel media message messages text content sticky fixed mobile desktop js is col row section item items posts stories articles follow legal copyright privacy".split())
_ABOUT = frozenset("has no with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first kind closes an open one of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("body html div section article main table ul ol dl blockquote td th".split())


class _Node:
    __slots__ = ("tag", "up", "drop", "own", "named", "points", "letters", "linked", "gain", "inner")

    def __init__(self, tag: str, up: _Node | None, drop: bool, own: bool, named: bool = False):
        self.tag, self.up, self.drop, self.own = tag, up, drop, own
        #: The parts around it, itself included, whose class or id is unwanted.
        self.named: tuple[_Node, ...] = up.named if up else ()
        if named:
            self.named += (self,)
        self.points = self.letters = self.linked = self.gain = self.inner = 0.0


def _names_unwanted(value: str) -> bool:
    """Whether one of the names in a class or id is that of an unwanted part."""
    for name in value.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if _ABOUT.isdisjoint(words) and (not _DROP_NAMES.isdisjoint(words) or not _WEAK_NAMES.isdisjoint(words) and words <= _WEAK_NAMES | _LAYOUT):
            return True
    return False


def _unwanted(tag: str, attrs: str, inside: bool) -> int:
    """2 for a part that goes, 1 for a form or one that its class or id calls unwanted."""
    if tag in _DROP_TAGS or tag == "header" and not inside:
        return 2
    if not attrs or tag in ("html", "body", "article", "main"):
        return int(tag == "form")
    named = int(tag == "form")
    for name, *value in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(value).lower()
        if name in ("class", "id") and _names_unwanted(value):
            named = 1
        if name == "role" and value.strip() in _DROP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return named


def _blocks(page: str) -> list[tuple[_Node, str, int]]:
    """(node, text, letters in links) of the blocks, in page order, but for parts that go whole."""
    root = _Node("html", None, False, False)
    now, out = root, []
    held: list[str] = []
    in_link, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and not now.drop:
                out.append((now, text, min(linked, len(text))))
            held.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
            elif tag == "br":
                held.append(" ")
            if m[2] or tag in _VOID or not _unwanted(tag, m[4], True):
                if m[2] and now.tag == tag:  # the end of an unwanted inline part
                    flush()
                    now = now.up or root
                continue
        flush()
        if m[2]:
            x = now
            while x is not root and x.tag != tag:
                x = x.up
            if x is not root:
                now = x.up
            elif tag == "p":
                continue
            in_link = 0
            continue
        if now.tag == "p" and tag != "p" or now.tag == "p":
            now = now.up or root
        if tag in _CLOSES:
            x = now
            while x is not root and x.tag not in _SCOPE - {"td", "th"} and x.tag not in _CLOSES[tag]:
                x = x.up
            if x.tag in _CLOSES[tag]:
                now = x.up or root
        if tag in _VOID or m[4].endswith("/") and tag not in _SCOPE:
            continue
        own = now.own or tag in ("article", "main")
        unwanted = _unwanted(tag, m[4], now.own)
        now = _Node(tag, now, now.drop or unwanted == 2, own, unwanted == 1)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def _gain(node: _Node, text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / len(text)) * (0.3 if node.tag in _HEADINGS else 1)


def _wanted(blocks: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """The blocks without those that a class or id calls unwanted, unless what it
    names lies around the articles or holds most of the page."""
    if not any(node.named for node, _, _ in blocks):
        return blocks
    for node, text, linked in blocks:
        gain, x, inner = _gain(node, text, linked) + 1e-9, node, False
        while x is not None:
            x.gain += gain
            x.inner += gain * inner  # what lies in an article below x
            inner = inner or x.tag in ("article", "main")
            root, x = x, x.up
    stays = (lambda x: 2 * x.inner >= root.inner) if root.inner else (lambda x: 2 * x.gain > root.gain)
    return [b for b in blocks if all(map(stays, b[0].named))]


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by line feeds."""
    blocks = _wanted(_blocks(page or ""))
    best, seen = None, []
    for node, text, linked in blocks:
        n = len(text)
        gain = _gain(node, text, linked)
        x, level = (node.up if node.tag in _HEADINGS or node.tag in ("p", "pre", "li", "blockquote", "td", "th", "dd", "dt", "tr") and node.up else node), 0
        y = node
        while y is not None:
            y.letters += n
            y.linked += linked
            y = y.up
        while x is not None:
            if not x.points:
                seen.append(x)
                x.points = 25.0 if x.tag == "article" else 1e-9
            x.points += gain / (1, 2, 6, 9, 12)[min(level, 4)]
            x, level = x.up, level + 1
    if not seen:
        return ""
    worth = {id(x): x.points * (1 - x.linked / max(1, x.letters)) for x in seen}
    best = max(seen, key=lambda x: worth[id(x)])
    x = best
    while x is not None:  # the element around it that names itself the article is taken whole
        if x.tag == "article":
            best = x
            break
        x = x.up
    least = max(10.0, 0.2 * worth[id(best)])
    kept = []
    for node, text, linked in blocks:
        x, child = node, node
        while x is not None and x is not best:
            child, x = x, x.up
        if x is None and best.up is not None and best.tag != "article":
            x = node
            while x is not None and x.up is not best.up:
                x = x.up
            if x is not None:
                dense = x.linked / max(1, x.letters)
                if not (worth.get(id(x), 0.0) >= least and dense < 0.3 or x.tag == "h1" and dense < 0.25 or x.tag == "p" and dense < 0.25 and (len(text) > 80 or dense == 0 and text[-1:] in ".!?")):
                    x = None
        if x is not None:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (its code points), for every row."""
    ship(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(whole := batch.column(len(keep)).to_pylist()):
                part = batch.slice(a, b - a)
                texts = [main_text(x) for x in whole[a:b]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    src = pages.select(*keep, pages[html_column].alias("__html"))
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
