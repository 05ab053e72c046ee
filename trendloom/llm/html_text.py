"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their tag path, root to leaf (names with classes). For
each path the length of its text and its punctuation are summed and divided by its nodes;
the two ratios are fused on a log scale and smoothed along the page, so that neighbours of
little text lower it. Labels and links are further features of a path: one that names
something else than an article (a menu, header, footer, sidebar, notice, advert, form or
discussion) loses COST of it, a link LINK_COST, in spreads (standard deviations) of the page's
own ratios. A menu's label costs little, as its ratios tell it apart; that of a discussion or a
footer, which may be prose, costs more. Nodes of at least the page's own threshold are content
nodes. The article is the deepest element that holds all content nodes, grown to the article
element (else main) around it, with a heading right above. What is in there stays, but for
labelled parts below the threshold and, outside an article element, low blocks that are mostly
links and low parts at either end.

So the ratios lead: a label weighs only as much as the page's ratios differ, and a labelled part
whose ratio stands out by more than its cost is content. Where labels are missing the ratios
decide alone.

A label is believed of a part beside the article element, and else of a part that holds
neither the main element nor over half of the content by the ratios alone: a wrapper named
has-sidebar, or a form around the whole page, costs nothing. A text that begins with a
copyright sign labels its element as a footer. Discussions may be longer than
what they discuss: they are believed if other content is left.

A block is the text between two block-level tags: character references are decoded, white
space becomes one space and the ends are trimmed; blocks are joined by an empty line. Text of
scripts, styles, frames, title and text areas is not read; that of any other element is,
noscript, math, svg, object, canvas and template among them.

Pages are independent: they are read in tasks and nothing is shuffled. Elements and paths are
trees of parent links, so time and memory are linear in a page however deep it nests.

Edge cases: null and empty pages, and pages without content, give the empty text; very long
and very deep pages are read whole; unclosed and stray tags are tolerated; where two parts are
equally good both stay; repeated rows are read one by one; result columns replace input
columns of the same name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import slices, small_batches, with_columns

_TOKEN = re.compile(r"<(?:!--|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text isn't the page's.
RAW = {"script", "style", "textarea", "title", "iframe"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that say nothing of what they hold.
PLAIN = {"section", "div", "td", "body", "html", "center", "span", "table", "tbody", "tr"}
#: Elements and roles that are something else than an article.
OTHER = {"nav", "aside", "footer", "menu", "head", "button", "select", "option", "dialog", "fieldset", "label"}
MENUS = {"nav", "menu", "button", "select", "option"}
MENU_ROLES = {"navigation", "menu", "menubar"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "status"}
#: Words in an id or class that name a part as something else.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "footer", "sidebar", "aside", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "form", "login", "signup", "signin", "subscribe", "newsletter", "masthead", "topbar",
}
#: Those that do so of a part beside an article only.
BESIDE = {"header", "reviews", "related", "recommended", "recommendations", "share", "sharing", "social", "search", "legal", "disclaimer", "copyright", "pager", "pagination", "widget", "widgets", "side", "rail", "skip", "toolbar", "banner"}
DISCUSSION = {"comment", "comments", "discussion", "disqus", "replies", "reply", "responses"}
#: Share of the content's characters that is left at least beside the parts whose labels are believed.
REST = 0.1
#: What the label of a path costs, more the more such parts are written like an article; what a link costs; and
#: how far below the mean a content node may be: all in spreads of the page's own ratios.
COST = {"menu": 0.5, "part": 2.5, "other": 2.5, "foot": 4.0, "copyright": 4.0, "discussion": 4.0}
LINK_COST = 0.75
BELOW = 0.5
KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
_PUNCT = re.compile("[.,;:!?。，、！？¿¡…]")
_COPYRIGHT = re.compile(r"\s*+(?:©|\(c\) |copyright\b)", re.I)
#: An opening tag on the left closes an open one on the right.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A closing tag other than those on the right doesn't reach beyond these.
_WALLS = {"article", "main", "body", "td", "table"}
_REACH = {"body", "html", "article", "main", "table", "tr", "tbody", "div", "section"}


@lru_cache(maxsize=4096)
def _label(tag: str, written: str, in_article: bool) -> tuple[str, str]:
    """An element's label in paths, and what it calls itself: a key of COST or ""."""
    attributes = {a[0].lower(): a[1] or a[2] or a[3] or "" for a in _ATTRIBUTE.findall(written)} if written else {}
    label = tag + "".join(f".{c}" for c in attributes.get("class", "").split())
    role = attributes.get("role", "").lower()
    if tag in OTHER or (tag == "header" and not in_article) or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return label, "foot" if "footer" == tag or role == "contentinfo" else "menu" if tag in MENUS or role in MENU_ROLES else "other"
    if tag in ("html", "body", "article", "main"):
        return label, ""
    names = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()))
    if tag == "form" or names & NAMES or (not in_article and names & BESIDE):
        return label, "part"
    return label, "discussion" if names & DISCUSSION else ""


class Page:
    """A parsed page. Elements by number in page order, 0 around all: tag, parent, path (a
    number for each tag path), kind (what it calls itself), link (in an a). Text segments:
    element, block and text; `nodes` are the numbers of those that are not blank."""

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.kind, self.link = [""], [-1], [0], [""], [False]
        self.element: list[int] = []
        self.block: list[int] = []
        self.text: list[str] = []
        self.nodes: list[int] = []
        self._parse(page)
        self.labelled = [False] * len(self.tag)  # is, or is inside, what a label says

    def _add(self, element: int, block: int, text: str) -> None:
        if text.strip():
            self.nodes.append(len(self.text))
            text = html.unescape(text)
            if not self.kind[element] and _COPYRIGHT.match(text) and self.tag[element] in ("div", "p", "small", "span", "td", "center"):
                self.kind[element] = "copyright"
        elif not text:
            return
        self.element.append(element)
        self.block.append(block)
        self.text.append(text)

    def _parse(self, page: str) -> None:
        stack = [0]
        at_tag: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
        walls: list[int] = []
        blocks: list[int] = []
        paths: dict[tuple[int, str], int] = {}
        articles = block = at = look = 0  # articles: how many are open

        def close(place: int) -> None:
            nonlocal articles
            while len(stack) > place:
                tag = self.tag[stack.pop()]
                at_tag[tag].pop()
                articles -= tag in ("article", "main")
                for places in (walls, blocks):
                    if places and places[-1] == len(stack):
                        places.pop()

        while (look := page.find("<", max(look, at))) >= 0:
            m = _TOKEN.match(page, look)
            if not m:  # a bare <
                look += 1
                continue
            self._add(stack[-1], block, page[at:look])
            at = m.end()
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            block += tag in BLOCK
            if tag == "br":
                self._add(stack[-1], block, " ")
            if m[1]:
                places = at_tag.get(tag)
                if places and (tag in _REACH or not walls or walls[-1] <= places[-1]):
                    close(places[-1])
                continue
            empty = m[3].endswith("/") and m[3][-2:-1] in ("", " ", '"', "'")  # not the end of a bare value
            if tag in RAW and not empty:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = len(page) if not end else page.find(">", end.end()) + 1 or len(page)
                continue
            if tag in VOID or empty and tag not in BLOCK:
                continue
            if tag in BLOCK:  # a block ends an open paragraph
                while blocks and self.tag[stack[blocks[-1]]] in ("p", *_CLOSES.get(tag, ())):
                    close(blocks[-1])
            label, kind = _label(tag, m[3], articles > 0)
            up, place = stack[-1], len(stack)
            key = (self.path[up], label)
            stack.append(len(self.tag))
            self.tag.append(tag)
            self.parent.append(up)
            self.path.append(paths.setdefault(key, len(paths) + 1))
            self.kind.append(kind)
            self.link.append(self.link[up] or tag == "a")
            at_tag.setdefault(tag, []).append(place)
            articles += tag in ("article", "main")
            if tag in _WALLS:
                walls.append(place)
            if tag in BLOCK:
                blocks.append(place)
        self._add(stack[-1], block, page[at:])

    def up(self, own: dict[int, int]) -> list[int]:
        """The sum of own (by element) over each element and all inside it."""
        out = [0] * len(self.tag)
        for e, v in own.items():
            out[e] += v
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def down(self, own: list[bool]) -> list[bool]:
        """Whether own holds of an element or of any around it."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def chars(self, nodes) -> dict[int, int]:
        """Characters of some nodes, by element."""
        out: dict[int, int] = {}
        for i in nodes:
            out[self.element[i]] = out.get(self.element[i], 0) + len(self.text[i])
        return out


def text_ratios(page: Page) -> np.ndarray:
    """For each node its path's characters a node times one plus its path's punctuation a
    node, on a log scale, smoothed with the neighbours."""
    sums: dict[int, list[int]] = {}
    for i in page.nodes:
        own = sums.setdefault(page.path[page.element[i]], [0, 0, 0])
        text = page.text[i]
        own[0] += len(text.strip())
        own[1] += len(_PUNCT.findall(text))
        own[2] += 1
    of = {p: np.log1p(c / n * (1 + k / n)) for p, (c, k, n) in sums.items()}
    ratio = np.array([of[page.path[page.element[i]]] for i in page.nodes])
    # neighbours lower what stands alone; they don't lift what is low by itself
    return np.minimum(ratio, np.convolve(np.pad(ratio, 2, mode="edge"), KERNEL, mode="valid")) if len(ratio) > 1 else ratio


def threshold(page: Page, ratio: np.ndarray, counted: np.ndarray, spread: float) -> float:
    """From which a node is content: a little below the mean over the counted text's characters,
    where text in links weighs next to nothing, as does what isn't counted."""
    size = np.array([0.01 if page.link[page.element[i]] else len(page.text[i]) for i in page.nodes])
    weight = size * np.where(counted, 1.0, 1e-6)
    return float((ratio * weight).sum() / weight.sum()) - BELOW * spread - 1e-9


def believed(page: Page, ratio: np.ndarray) -> list[bool]:
    """Whether an element is, or is inside, what its label says. ratio: without labels."""
    n = len(page.tag)
    marked = [t in ("article", "main") for t in page.tag]
    other = page.down([k in ("menu", "other", "foot") for k in page.kind])
    named = [k in ("part", "copyright", "discussion") for k in page.kind]
    if not any(named):
        return other
    in_named, in_marked = page.down(named), page.down(marked)
    texts = {page.element[i] for i in page.nodes if not other[page.element[i]]}
    free = any(in_marked[e] and not in_named[e] for e in texts)  # an article in no such part
    around = page.up({e: 1 for e in range(n) if marked[e] and not other[e]})
    mains = page.up({e: 1 for e in range(n) if page.tag[e] == "main" and not other[e]})
    kept = [k for k, i in enumerate(page.nodes) if page.element[i] in texts]
    if not kept:
        return other
    least = threshold(page, ratio, np.array([page.element[i] in texts for i in page.nodes]), float(ratio.std()))
    content = [page.nodes[k] for k in kept if ratio[k] >= least and not page.link[page.element[page.nodes[k]]]]
    size = page.up(page.chars(content))
    total = size[0]
    talk = [k == "discussion" for k in page.kind]
    beside = [named[e] and free and not (in_marked[e] and not marked[e]) and not mains[e] and (2 * size[e] <= total or not around[e] or talk[e]) for e in range(n)]
    gone = page.down(beside)
    size = page.up(page.chars(i for i in content if not gone[page.element[i]]))
    total = size[0]
    small = [named[e] and not mains[e] and 2 * size[e] <= total for e in range(n)]
    tries = [[s or (t and not m) for s, t, m in zip(small, talk, mains, strict=True)], small, [s and z < REST * total for s, z in zip(small, size, strict=True)]]
    for out in tries:
        without = page.down([a or b for a, b in zip(beside, out, strict=True)])
        left = sum(len(page.text[i]) for i in content if not without[page.element[i]])
        if left >= REST * total or out is tries[-1]:
            break
    return [a or b for a, b in zip(other, without, strict=True)]


def path_ratios(page: Page) -> tuple[np.ndarray, float]:
    """The fused ratio of each node, which is that of text and punctuation less the cost of its
    path's labels, and the page's threshold. page.labelled keeps which labels are believed."""
    ratio = text_ratios(page)
    page.labelled = believed(page, ratio)
    spread = float(ratio.std())
    cost = [COST.get(k, 0.0) for k in page.kind]
    for e in range(1, len(cost)):
        cost[e] = max(cost[e], cost[page.parent[e]])
    own = np.array([page.labelled[page.element[i]] for i in page.nodes])
    linked = np.array([page.link[page.element[i]] for i in page.nodes])
    fused = ratio - spread * (own * np.array([cost[page.element[i]] for i in page.nodes]) + linked * LINK_COST)
    return fused, threshold(page, fused, ~own, spread)


def main_text(source: str) -> str:
    page = Page(source)
    if not page.nodes:
        return ""
    ratio, least = path_ratios(page)
    if all(page.labelled[page.element[i]] for i in page.nodes):
        return ""
    seeds = {i for i, r in zip(page.nodes, ratio.tolist(), strict=True) if r >= least}
    inside, article = region_of(page, seeds)
    blocks: dict[int, list] = {}  # texts, characters, characters in links, whether a content node is there
    for i, (e, b) in enumerate(zip(page.element, page.block, strict=True)):
        if inside[e] and (i in seeds or not page.labelled[e]):
            of = blocks.setdefault(b, [[], 0, 0, False])
            of[0].append(page.text[i])
            of[1] += len(page.text[i].strip())
            of[2] += len(page.text[i].strip()) * page.link[e]
            of[3] = of[3] or i in seeds
    out = []
    for parts, size, linked, content in blocks.values():
        text = " ".join("".join(parts).split())
        if text and (article or content or 2 * linked <= size):
            out.append(text)
    return "\n\n".join(out)


def region_of(page: Page, seeds: set[int]) -> tuple[list[bool], bool]:
    """Whether each element is in the article that the content nodes span, and whether an
    article element holds them."""
    held: dict[int, int] = {}
    for i in seeds:
        held[page.element[i]] = held.get(page.element[i], 0) + 1
    held = page.up(held)
    top = max((e for e in range(len(held)) if held[e] == held[0]), default=0) if seeds else 0
    while page.tag[top] not in PLAIN | {"", "article", "main"}:
        top = page.parent[top]
    around = [top]
    while around[-1]:
        around.append(page.parent[around[-1]])
    marked = [e for t in ("article", "main") for e in reversed(around) if page.tag[e] == t]
    top = marked[0] if marked else top
    over = {e for e in around if e < top}
    own = [False] * len(page.tag)
    own[top] = True
    for e in range(1, top):  # headings right above
        up = page.parent[e]
        own[e] = up in over and (page.tag[e] == "h1" or page.tag[e] == "h2" and page.tag[up] not in ("html", "body", ""))
    inside = page.down(own)
    if not marked and held[top]:  # plain parts before the first content node, and after the last
        children = [e for e in range(top + 1, len(page.tag)) if page.parent[e] == top]
        full = [e for e in children if held[e]]
        cut = [False] * len(page.tag)
        for e in children if full else ():
            cut[e] = page.tag[e] in PLAIN and not full[0] <= e <= full[-1]
        inside = [a and not b for a, b in zip(inside, page.down(cut), strict=True)]
    return inside, bool(marked) and page.tag[top] == "article"


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, the main text of each."""
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([main_text(p) for part in slices(column) for p in part], pa.string())

    return with_columns(pages, text=read(F.coalesce(F.col(html_col), F.lit(""))))
