"""HTML extraction (operator 1): the main text of pages by the text-to-tag ratio of their lines.

The standard library's parser is read as a stream of events. Block elements cut a page into lines; what lies in elements
that are never text (scripts, styles, menus, footers, controls, hidden ones) is left out piece by piece, also in the middle
of a line. For each line the ratio of unlinked characters to tags is taken, the ratios are smoothed with a Gaussian kernel
over neighbouring lines, and lines at or above a threshold (a multiple of the standard deviation) are the content cluster.

The elements form a tree in the order of their start, and each gets the sums of what lies below it in one pass backwards:
characters, linked ones, and those of the cluster. These sums decide twice. An element that its class, id, role or name marks
as furniture (sidebars, notices, adverts, forms, reader comments) is left out only if it doesn't hold most of the page's
content: what does is a frame around the article, whatever its name. And they select the regions: the articles that hold
content, the main element, or else the smallest container of nearly all of it. Within a region paragraphs, headings, items
and cells stay, however short; the cluster decides on blocks with half a mark, short lists of links, and text that stands in
no element for text and is mostly tags. Everything is linear in the page, however deep or unclosed its elements are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML elements by role, and the words in class, id and role attributes that mark page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog embed footer frame frameset head header iframe input menu nav "
    "noscript object optgroup option script search select style svg template textarea title video".split()
)
#: Parts of forms that may also stand in a sentence, and elements that are furniture unless they hold most of the content.
CONTROLS, FRAMES = frozenset("label meter output progress".split()), frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | frozenset("p li blockquote pre tr td th dd dt figcaption caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising banner sponsor sponsored promo promos promoted promotion "
    "cookie cookies consent gdpr notice notices alert alerts notification sidebar sidebars aside comment comments commentlist disqus "
    "replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login signin menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead popup modal overlay toolbar "
    "widget widgets skip search contentinfo complementary teaser teasers outbrain taboola".split()
)
#: Words that mark furniture at either end of a compound class, such as site-footer.
ENDS = frozenset(
    "ad ads advert adverts advertisement sponsored promo cookie cookies consent gdpr sidebar comment comments disqus newsletter nav navbar navigation menu footer "
    "breadcrumb breadcrumbs pagination popup modal toolbar outbrain taboola".split()
)
#: Words of classes that tell a state of what they stand on, such as no-comments or has-sidebar.
STATES = frozenset("no non not has have with without is are category cat tag tags type format status open opened closed enabled disabled on off layout hide hidden show".split())
READERS = frozenset("comment comments commentlist disqus replies reply respond related recommended recommendations".split())
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Why text is left out: not at all, as the header of its region (whose headings stay), for good.
_SHOWN, _HEADER, _OUT = 0, 1, 2


class _Node:
    """An element: its place in the tree, what its attributes say, and the sums of the lines below it."""

    __slots__ = ("tag", "parent", "depth", "block", "dropped", "readers", "region", "code", "text", "mark", "of_readers", "h1", "size", "linked", "content", "strong", "out", "inside", "outer", "in_main")

    def __init__(self, tag, parent):
        self.tag, self.parent, self.mark, self.of_readers = tag, parent, 0, False
        self.size = self.linked = self.content = self.strong = 0
        self.h1, self.out, self.inside, self.outer, self.in_main = tag == "h1", False, False, None, False
        if parent is None:
            self.depth, self.block, self.dropped, self.readers, self.region, self.code, self.text = 0, self, _SHOWN, False, False, False, False
        else:
            self.depth, self.block = parent.depth + 1, self if tag in BLOCK else parent.block
            self.dropped, self.readers, self.region = parent.dropped, parent.readers, parent.region
            self.code, self.text = parent.code or tag in ("pre", "code"), parent.text or tag in TEXT


def _marked(tag: str, attrs: list[tuple[str, str | None]], region: bool) -> tuple[int, bool]:
    """How surely the attributes mark furniture (0 not, 1 doubtful, 2 surely), and whether they name reader comments.

    Whole classes and roles are sure, and whole ids of containers outside of an article. Of compounds those of containers that
    begin or end with a mark are sure and others doubtful; those that tell a state say nothing, and neither do compounds of an
    article, which name its tags and categories. Ids of headings and paragraphs are titles.
    """
    sure, readers, text, whole_only = 0, False, tag in TEXT, tag in ("article", "main")
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            sure = 2
        elif name in ("class", "id"):
            for word in value.split() if name == "class" else [value.strip()]:
                if (whole := word.lower()) in MARKS:
                    if name == "class" or not text:
                        of_readers = whole in READERS
                        sure = max(sure, 2 if name == "class" or of_readers or not (region or tag in ("section", "article")) else 1)
                        readers = readers or of_readers
                    continue
                parts = [x.lower() for x in _PART.findall(word)]
                if whole_only or len(parts) < 2 or STATES.intersection(parts) or (name == "id" and text):
                    continue
                if parts[0] in ENDS or parts[-1] in ENDS:
                    sure, readers = max(sure, 1 if text or name == "id" else 2), readers or bool(READERS.intersection(parts) and not text and name == "class")
                elif name == "class" and MARKS.intersection(parts):
                    sure = max(sure, 1)
    return sure, readers


class _Lines(HTMLParser):
    """Lines of a page without what is never text: text, number of tags, characters in links, the element they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.nodes = [_Node("", None)]
        self._top = self.nodes[0]
        self._open_tags: dict[str, list[_Node]] = {}
        self._parts: list[str] = []
        self._tags = self._linked = self._in_link = 0

    def flush(self) -> None:
        if self._parts:
            if text := " ".join("".join(self._parts).split()):
                self.lines.append([text, max(1, self._tags), self._linked, self._top.block])
            self._parts = []
        elif self.lines and self._tags:
            self.lines[-1][1] += self._tags
        self._tags = self._linked = 0

    def _close_to(self, node: _Node) -> None:
        while self._top is not node:
            self._open_tags[self._top.tag].pop()
            if self._top.tag == "a":
                self._in_link = max(0, self._in_link - 1)
            self._top = self._top.parent

    def _open(self, tag: str, within: Iterable[str]) -> _Node | None:
        """The innermost open element of a name, unless one of the others is open inside it."""
        found = self._open_tags.get(tag)
        if not found:
            return None
        depth = found[-1].depth
        return None if any(others[-1].depth >= depth for w in within if (others := self._open_tags.get(w))) else found[-1]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            p = self._open("p", ("article", "main", "section", "div", "td", "th", "li", "button", "select", "object", "svg", "body"))
            if p is not None or not self._top.dropped or tag in ("article", "main"):
                self.flush()
            if p is not None:
                self._close_to(p.parent)
        if tag in CLOSES and (old := self._open(tag, CLOSES[tag])) is not None:
            self._close_to(old.parent)
        up = self._top
        if tag in ("br", "td", "th") and not up.dropped:
            self._parts.append(" ")
        if tag in VOID:
            self._tags += not up.dropped
            return
        node = _Node(tag, up)
        marked, of_readers = (0, False) if up.code else _marked(tag, attrs, up.region)
        hidden = any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value)) for name, value in attrs)
        if tag in ("html", "body"):
            pass
        elif tag == "main" or (tag == "article" and not of_readers and not up.readers and not hidden):
            if node.dropped and not up.region:
                node.dropped = _SHOWN  # an element left open before the region doesn't hide it
            node.region, node.mark = True, marked if tag == "article" else 0
        else:
            node.readers = up.readers or of_readers or tag == "aside"
            never = tag in FURNITURE or (tag in CONTROLS and not up.text)
            if tag in HEADINGS and node.dropped == _HEADER and not hidden and marked < 2:
                node.dropped = _SHOWN  # the heading of the article itself
            elif hidden or never or (marked == 2 and tag not in BLOCK):
                node.dropped = _HEADER if tag == "header" and up.region and node.dropped < _OUT and not hidden and marked < 2 else _OUT
            elif tag in BLOCK:
                node.mark, node.of_readers = 2 if tag in FRAMES else marked, of_readers
        self._tags += not node.dropped
        if tag == "a":
            self._in_link += 1
        node.h1 = node.h1 and not node.dropped
        self._top = node
        self.nodes.append(node)
        self._open_tags.setdefault(tag, []).append(node)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        # an inline element's end doesn't reach over the block around it
        node = self._open(tag, () if tag in BLOCK else ("article", "main", "section", "div", "body", "table", "td"))
        if tag in BLOCK and not (self._top if node is None else node).dropped:
            self.flush()
        if node is not None:
            self._tags += not node.dropped
            self._close_to(node.parent)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._top.tag == tag:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self._top.dropped:
            return
        self._parts.append(data)
        if self._in_link:
            self._linked += len(data)


def content_lines(ratios: np.ndarray, sigma: float = 1.0, strength: float = 0.5) -> np.ndarray:
    """The content cluster: 1 where the smoothed ratio is at or above ``strength`` standard deviations, or is the largest; 2
    where the line's own ratio is so too, without its neighbours; else 0."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:-radius]
    smooth = np.convolve(ratios, kernel)[radius:-radius] / weight
    limit = min(strength * smooth.std(), smooth.max())
    return np.where(smooth >= limit, np.where(ratios >= limit, 2, 1), 0)


def _sum_up(nodes: list[_Node], lines: list[list], chosen: np.ndarray) -> None:
    """Each element's sums over the lines below it that aren't left out: a parent stands before its children."""
    for node in nodes:
        node.size = node.linked = node.content = node.strong = 0
    for (text, _, linked, node), kind in zip(lines, chosen):
        if not node.out:
            own = max(0, len(text) - linked)
            node.size += len(text)
            node.linked += linked
            node.content += len(text) if kind else 0
            node.strong += own if kind == 2 else 0
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.size += node.size
            up.linked += node.linked
            up.content += node.content
            up.strong += node.strong
            up.h1 = up.h1 or node.h1


def _leave_out(nodes: list[_Node]) -> None:
    """Marked elements that hold less than half of the content, those of readers also if they hold more but no title; doubtful
    ones if the cluster has less than half of their text."""
    total = nodes[0].content
    for node in nodes[1:]:
        most = 2 * node.content >= total and node.content > 0
        if node.parent.out:
            node.out = True
        elif node.mark == 2:
            node.out = not (most and (node.h1 or not node.of_readers))
        elif node.mark == 1:
            node.out = not most and 2 * node.strong < node.size


def _regions(nodes: list[_Node]) -> None:
    """Tell which elements lie in the article: those marked as one that hold content, else the smallest container of it."""
    total, articles, mains, best = nodes[0].content, [], [], nodes[0]
    for node in nodes[1:]:
        up = node.parent
        node.outer, node.in_main = up.outer, up.in_main or node.tag == "main"
        if node.out:
            continue
        if node.tag == "article" and node.region and up.outer is None:
            node.outer = node
            if node.content > 0 and 2 * node.linked <= node.size:  # teasers are articles of links
                articles.append(node)
        elif node.tag == "main" and not up.in_main and node.content > 0:
            mains.append(node)
        if node.content >= 0.8 * total and node.tag not in TEXT and node.depth > best.depth:
            best = node
    of = lambda found: sum(n.content for n in found)
    if 4 * of(articles) < of(mains or nodes[:1]):
        articles = []  # cards beside the text
    if articles and (not mains or of(n for n in articles if n.in_main) >= 0.8 * of(mains)):
        chosen = articles
    else:
        chosen = mains or articles or [best]
    for node in chosen:
        node.inside = True
    for node in nodes[1:]:
        node.inside = node.inside or node.parent.inside


def main_text(html: str | None, sigma: float = 1.0, strength: float = 0.5) -> str:
    """The main text of a page: its blocks in page order, white space inside each as one space, joined by a line break."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, nodes = parser.lines, parser.nodes
    if not lines:
        return ""
    chosen = content_lines(np.array([max(0, len(text) - linked) / tags for text, tags, linked, _ in lines]), sigma, strength).tolist()
    _sum_up(nodes, lines, chosen)
    _leave_out(nodes)
    _sum_up(nodes, lines, chosen)
    _regions(nodes)
    first = next((k for k, line in enumerate(lines) if line[3].inside and not line[3].out), len(lines))
    kept, titled = [], False
    for k, ((text, tags, linked, node), kind) in enumerate(zip(lines, chosen)):
        if node.out:
            continue
        if not node.inside:
            if k < first and node.tag == "h1" and node.region:
                kept.append(text)  # the title stands before the article, in the main element
            continue
        if node.tag in TEXT and (node.tag != "li" or linked <= 0.8 * len(text)):
            stays = True
        elif node.tag == "li":  # sources have names or a heading, menus haven't
            stays = titled or len(text.split()) > 2
        else:
            stays = 2 * linked <= len(text) and tags <= len(text.split()) + 1
        if stays or kind == 2:
            kept.append(text)
        titled = node.tag in HEADINGS or (titled and node.tag == "li")
    return "\n".join(kept)


def extract(pages: DataFrame, sigma: float = 1.0, strength: float = 0.5, html: str = "html") -> DataFrame:
    """Every row with ``text`` and ``n_chars`` (code points) instead of its HTML.

    Null and empty HTML, and pages of furniture only, have the empty text. Repeated rows stay; columns named text or
    n_chars that the input has are replaced. A map over rows: only the HTML goes to Python.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h, sigma, strength) for h in batch], dtype=object)

    out = pages.withColumn("text", text(F.col(html)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).drop(*([html] if html not in ("text", "n_chars") else []))
