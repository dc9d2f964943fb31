"""Main text of web pages by two-pass block rules.

Markup is cut into blocks at block-level tags. The first pass decides a block by the containers it
stands in, its link density, its length and its density of stop words; short blocks stay ambiguous.
In the second pass an ambiguous block takes the label of its nearest decided neighbour.

A container is boilerplate by its tag (a menu, a footer) or by its class, id, role or being a form. Of
class and id whole words count, and compounds that end in one (site-footer) unless they tell of a
layout (no-sidebar, has-menu). What a class says does not stand against the page: such a container is
none if all articles of the page are inside, or, on a page without an article, most of its text and no
good block is outside. An unclosed boilerplate container ends where an article opens.

Defined cases: null or empty html gives an empty text; markup cut off anywhere is read as far as it
goes; a page of any length is read whole; repeated rows give repeated rows; other columns stay as they
are, but for columns named text or n_chars, which the result replaces.
"""

from __future__ import annotations

import bisect
import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm.workers import small_batches

# Tag names, words in class and id attributes, and frequent words of four languages.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "title", "head", "button", "audio", "video", "canvas"}
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "template", "svg", "math", "object", "select", "button", "audio", "video", "canvas"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
MAIN_TAGS = {"article", "main"}
CONTAINERS = BOILER_TAGS | MAIN_TAGS | {"header", "div", "section", "ul", "ol", "dl", "table", "figure", "blockquote", "fieldset", "details"}
BLOCK_TAGS = CONTAINERS | {"html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "pre", "hr", "address", "center", "summary", "legend", "option", "noscript"}
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "sidebar", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "respond", "replies",
    "share", "sharing", "social", "related", "recommended", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "skip",
}
STOP_WORDS = set(
    "the of and to in a is that it for on with as was be by this are at from or an not have he they his but which you she there been their has "
    "de la le les des et un une du en que qui est dans pour pas sur par au avec il elle ne se plus ce son sont ou mais "
    "der die und das den von zu mit sich dem nicht ein eine ist auf als im auch es an werden aus er hat dass sie nach bei oder "
    "el los las y del se por con una su para al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

LINKS, LONG, STOP_HIGH, STOP_LOW = 0.5, 70, 0.15, 0.05
BAD, SHORT, GOOD = 0, 1, 2


#: Parts of a class name that tell of a layout, not of what the container is.
LAYOUT_WORDS = {"no", "not", "non", "has", "have", "with", "without", "hide", "hidden", "show", "is", "are", "under", "above", "below", "after", "before"}
TAG, WORDS = "by its tag", "by its words"


def _names_boilerplate(value: str) -> bool:
    for word in value.split():
        parts = re.split("[_-]+", word.strip("_-"))
        if word in BOILER_WORDS or (parts[-1] in BOILER_WORDS and not LAYOUT_WORDS.intersection(parts)):
            return True
    return False


def _boilerplate(name: str, attrs: str, in_main: bool) -> str | None:
    """Whether a container is boilerplate: by its tag, by its words, or not."""
    if (name in BOILER_TAGS and name != "form") or (name == "header" and not in_main):
        return TAG
    if name in MAIN_TAGS or name == "body":
        return None
    if HIDDEN.search(attrs):
        return TAG
    for key, value in ATTR.findall(attrs):
        value, key = value.strip("\"'").lower(), key.lower()
        if key == "aria-hidden" and value == "true":
            return TAG
        if (key == "role" and value in ROLES) or (key in ("class", "id") and _names_boilerplate(value)):
            return WORDS
    return WORDS if name == "form" else None


class _Containers:
    """The open containers of a page, and a tree of those that look like boilerplate: node 0 is the page itself."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.stack: list[tuple[str, int, bool]] = []  # tag, innermost boilerplate node before it, and whether it is one itself
        self.open: dict[str, int] = {}
        self.node = 0
        self.parent, self.kind, self.articles = [0], [None], [0]
        self.main = 0
        self.marks: dict[str, tuple[list[int], list[int]]] = {}

    def enter(self, name: str, attrs: str, at: int) -> None:
        if name in MAIN_TAGS:
            self._end_unclosed(at)
            self.main += 1
            self.articles[self.node] += 1
        kind = _boilerplate(name, attrs, self.main > 0)
        self.stack.append((name, self.node, kind is not None))
        self.open[name] = self.open.get(name, 0) + 1
        if kind:
            self.parent.append(self.node)
            self.kind.append(kind)
            self.articles.append(0)
            self.node = len(self.kind) - 1

    def leave(self, name: str) -> None:
        """A closing tag ends the last container of its name and all inside; one that closes nothing is passed over."""
        if self.open.get(name):
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name, self.node, _ = self.stack.pop()
        self.open[name] -= 1
        self.main -= name in MAIN_TAGS
        return name

    def _left(self, name: str, at: int) -> int:
        """How many containers of this name that are open at a place the rest of the page closes."""
        if name not in self.marks:
            found = [(m.start(), m[0][1] == "/") for m in re.finditer(rf"</?{name}(?=[\s/>]|\Z)", self.page, re.I)]
            self.marks[name] = ([i for i, closes in found if not closes], [i for i, closes in found if closes])
        opens, closes = self.marks[name]
        return (len(closes) - bisect.bisect_left(closes, at)) - (len(opens) - bisect.bisect_left(opens, at))

    def _end_unclosed(self, at: int) -> None:
        if not self.node:
            return
        met: dict[str, int] = {}
        for place, (name, _, boiler) in enumerate(self.stack):
            met[name] = met.get(name, 0) + 1
            # the last ones opened are closed first, so what is never closed is the outermost
            if boiler and met[name] <= self.open[name] - max(0, self._left(name, at)):
                while len(self.stack) > place:
                    self._pop()
                return


def _stands(tree: _Containers, found: list[tuple[str, int, int, bool]]) -> list[bool]:
    """Whether each node is boilerplate, its own or that of a node around it, after what the page says against it."""
    n = len(tree.kind)
    size, articles = [0] * n, tree.articles[:]
    for text, _, node, _ in found:
        size[node] += len(text)
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        articles[tree.parent[i]] += articles[i]
    good_outside = any(node == 0 and first_pass((text, linked, False, main)) == GOOD for text, linked, node, main in found)
    out = [False] * n
    for i in range(1, n):
        spoken_against = articles[i] == articles[0] if articles[0] else not good_outside and 2 * size[i] > size[0]
        out[i] = out[tree.parent[i]] or not (tree.kind[i] == WORDS and spoken_against)
    return out


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, in a boilerplate container, in an article) in page order."""
    out: list[tuple[str, int, int, bool]] = []
    tree = _Containers(page)
    parts: list[str] = []
    linked = link = breaks = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, tree.node, tree.main > 0))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            raw = page[at : m.start()]
            if breaks and not raw.isspace():
                breaks = 0
            say(raw)
        at = m.end()
        if m["cdata"]:
            say(m["cdata"])
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m["close"] or m["close2"]), m["attrs"] or ""
        if name in RAW and not closing:
            if name in BLOCK_TAGS:
                flush()
            parts.append(" ")
            if not attrs.endswith("/") or name in ("script", "style", "title", "textarea"):
                over = ENDS[name].search(page, at)
                at = over.start() if over else end
            continue
        if name == "br":
            breaks += 1
            flush() if breaks > 1 else parts.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name in BLOCK_TAGS:
            flush()
            link = breaks = 0
            if name in CONTAINERS:
                tree.leave(name) if closing else tree.enter(name, attrs, at)
    flush()
    boiler = _stands(tree, out)
    return [(text, linked, boiler[node], main and not boiler[node]) for text, linked, node, main in out]


def first_pass(block: tuple[str, int, bool, bool]) -> int:
    text, linked, boiler, main = block
    if boiler or linked > LINKS * len(text):
        return BAD
    words = text.lower().split()
    dense = sum(w.strip(".,;:!?%$#&*()\"'|") in STOP_WORDS for w in words) / len(words)
    if len(text) >= LONG and dense >= STOP_HIGH:
        return GOOD
    if len(text) >= 3 * LONG:
        return GOOD if main or dense >= STOP_LOW else BAD
    return SHORT


def second_pass(labels: list[int], mains: list[bool]) -> list[bool]:
    """An ambiguous block inherits from its nearest decided neighbour; one in an article looks at decided blocks of
    articles only. Where two as near differ, or none is there, a block in an article stays and another goes."""
    n = len(labels)

    def nearest(order: range, wanted: bool) -> list[tuple[int, int] | None]:
        found: list[tuple[int, int] | None] = [None] * n
        last = None
        for i in order:
            found[i] = last
            if labels[i] != SHORT and (mains[i] or not wanted):
                last = (i, labels[i])
        return found

    sides = {wanted: (nearest(range(n), wanted), nearest(range(n - 1, -1, -1), wanted)) for wanted in (False, True)}
    keep = []
    for i, label in enumerate(labels):
        if label == SHORT:
            near = [(abs(x[0] - i), x[1]) for x in (sides[mains[i]][0][i], sides[mains[i]][1][i]) if x]
            nearest_labels = {x for d, x in near if d == min(near)[0]}
            label = nearest_labels.pop() if len(nearest_labels) == 1 else GOOD if mains[i] else BAD
        keep.append(label == GOOD)
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = second_pass([first_pass(b) for b in found], [b[3] for b in found])
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to pages."""

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    return pages.withColumn("text", text_of(F.col(html_col).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
