"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events. Text between the boundaries of blocks makes lines; each line knows its tags,
the characters inside links and the container it stands in. Elements that never hold the article (menus, headers,
footers, sidebars, forms, scripts, styles, and any element whose class, id or role names an advert, a notice, comments or
the like) are passed over with all they hold. A form or a block with such a name may be the layout around the article: its
lines are recorded, and if the page's article lies in it and not outside, they count like any others.

Each line's ratio of characters to tags is smoothed by a Gaussian over its neighbours, and lines at or above the threshold
form the clusters of content. A cluster selects its region: the whole article (or main element) it lies in, so that a
short paragraph or a heading of the article is kept as it is; on a page without one, the lines of the cluster, and those
of the same container that are not mostly links.

Cases: null or empty html, or html without text, gives an empty text; markup left open is closed with its parent; a page is
read whole, whatever its length; repeated rows give equal results; an empty table gives no rows. Input columns named like
an output are replaced by it.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import packed, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: HTML's elements by role, and the words that name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select"
    " summary table tbody tfoot thead title tr ul".split()
)
PASSED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea input menu dialog"
    " iframe object svg canvas audio video map".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo"
    " cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination"
    " popup promo promotion related replies reply respond search share sharing sidebar social sponsor sponsored"
    " subscribe toolbar widget".split()
)
ENDED_BY_NEXT = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"])}
#: Before a name, as in "no-sidebar", these say how the page is laid out, not what the element is.
LAYOUT = frozenset("no not with without has".split())
SPACED = frozenset(["br", "td", "th", "img", "wbr"])

SIGMA = 1.5


def hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in PASSED:
        return tag != "form"
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I):
            return True
    return False


def named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        for token in (value or "").lower().split() if name in ("class", "id", "role") else ():
            words = re.split("[^a-z0-9]+", token)
            if any(w in NAMES and before not in LAYOUT for before, w in zip(["", *words], words, strict=False)):
                return True
    return tag == "form"


class Line:
    __slots__ = ("text", "tags", "linked", "article", "container", "wrappers")

    def __init__(self, text: str, tags: int, linked: int, article: int, container: int, wrappers: tuple[int, ...]):
        self.text, self.tags, self.linked, self.article, self.container = text, tags, linked, article, container
        self.wrappers = wrappers


class Lines(HTMLParser):
    """The page's lines outside the elements passed over, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = self.elements = 0
        self.tags: dict[tuple[int, ...], int] = defaultdict(int)  # by the wrappers they stand in
        self.articles: dict[int, tuple[bool, tuple[int, ...]]] = {}  # main, wrappers it stands in
        # tag, passed over, article it is in, block that holds its lines, forms and named blocks it is in
        self.open: list[tuple[str, bool, int, int, tuple[int, ...]]] = []
        # Open blocks by tag; inline elements by tag that were opened in each open block; open links.
        self.blocks: dict[str, int] = defaultdict(int)
        self.inline: list[dict[str, int]] = [defaultdict(int)]
        self.links = 0

    @property
    def top(self) -> tuple[str, bool, int, int, tuple[int, ...]]:
        return self.open[-1] if self.open else ("", False, 0, 0, ())

    def count(self, tag: str, by: int) -> None:
        if tag in BLOCKS:
            self.blocks[tag] += by
            if by > 0:
                self.inline.append(defaultdict(int))
            else:
                self.inline.pop()
        else:
            self.inline[-1][tag] += by
            self.links += by * (tag == "a")

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            container, wrappers = self.top[3:]
            self.lines.append(Line(text, self.tags.pop(wrappers, 0), self.linked, self.top[2], container, wrappers))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.elements += 1
        if tag in BLOCKS:
            if self.open and tag in ENDED_BY_NEXT.get(self.open[-1][0], ()):
                self.handle_endtag(self.open[-1][0])
            self.cut()
        _, passed, article, container, wrappers = self.top
        if not passed:
            self.tags[wrappers] += 1
            if tag in SPACED:
                self.parts.append(" ")
        if tag in VOID:
            return
        passed = passed or hidden(tag, attrs)
        if not passed and named(tag, attrs):
            if tag in BLOCKS:
                wrappers = (*wrappers, self.elements)
            else:
                passed = True
        if not article and (tag in ("article", "main") or ("role", "main") in attrs):
            article = self.elements
            self.articles[article] = (tag != "article", wrappers)
        if tag in BLOCKS and tag not in ENDED_BY_NEXT and tag[1:].isalpha():
            container = self.elements
        self.open.append((tag, passed, article, container, wrappers))
        self.count(tag, 1)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        # An inline end tag closes nothing beyond the block it stands in.
        if self.blocks[tag] if tag in BLOCKS else self.inline[-1][tag]:
            while True:
                last = self.open.pop()[0]
                self.count(last, -1)
                if last == tag:
                    break
        if not self.top[1]:
            self.tags[self.top[4]] += 1

    def handle_data(self, data):
        if not self.top[1]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self.cut()
        around = self.around()
        self.lines = [x for x in self.lines if around.issuperset(x.wrappers)]

    def around(self) -> set[int]:
        """Forms and named blocks that are the layout around the article: the fewest that any article or main element
        lies in. An article, unlike a main element, must hold more text than the page has outside of such blocks."""
        held: dict[int, int] = defaultdict(int)
        for x in self.lines:
            if x.article and x.wrappers == self.articles[x.article][1]:
                held[x.article] += len(x.text)
        outside = sum(len(x.text) for x in self.lines if not x.wrappers)
        regions = [self.articles[a] for a, n in held.items() if self.articles[a][0] or not self.articles[a][1] or n > outside]
        least = min((len(wrappers) for _, wrappers in regions), default=0)
        return {w for _, wrappers in regions if len(wrappers) == least for w in wrappers}


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weights


def content(lines: list[Line]) -> list[Line]:
    """The lines of the regions that a cluster of high ratios lies in."""
    if not lines:
        return []
    ratios = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    high = ratios >= min(ratios.std(), ratios.max())
    articles = {x.article for x, h in zip(lines, high, strict=True) if h and x.article}
    if articles:
        return [x for x in lines if x.article in articles]
    prose = [2 * x.linked <= len(x.text) for x in lines]
    chosen = {x.container for x, h, p in zip(lines, high, prose, strict=True) if h and p}
    return [x for x, h, p in zip(lines, high, prose, strict=True) if p and (h or x.container in chosen)]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    return "\n\n".join(x.text for x in content(parser.lines))


def _extracted(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([main_text(h.as_py() or "") for h in batch], pa.string())


def main_texts(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Every row with its main ``text``."""
    return unpacked(pages.select(packed(pages, carry), F.arrow_udf(_extracted, "string")(F.col(html_col)).alias("text")), "text")
