"""Main text of web pages, from the events of the standard library's HTML parser.

Events are cut into lines: a block-level tag begins and ends one. A line has a
text-to-tag ratio (characters of text over tags, links counted twice). The ratios are
smoothed by a Gaussian over neighbouring lines; lines whose smoothed ratio reaches
the standard deviation of the ratios are content, their neighbours in the page
form clusters. The content region is the element that the clusters point at: an
article that holds one, else a main element, else the innermost element with
``SHARE`` of the clusters' text together with what clusters lie outside. The whole
region is returned, short lines too, but for elements that markup declares as no
part of it: menus, headers and footers of the page, sidebars, forms, scripts,
adverts, notices, reader comments (by element, role, or words of class and id).

One page is parsed in one pass of linear time; nothing but its lines is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, slices

SIGMA = 1.0  # of the Gaussian, in lines
SHARE = 0.8  # of the clusters' text that the innermost element of a page without article or main holds

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist textarea button".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split()
)
SPACED = frozenset("br td th option".split())
REGIONS = frozenset(("article", "main"))
HOLDERS = frozenset("article main section div td body html".split())
ENDS_P = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption", "li", "dd", "dt", "summary", "figcaption"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words of class and id attributes that name parts around an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification"
    " popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar"
    " widget widgets related recommended recommendations social share sharing comment comments respond disqus replies login search pagination pager".split()
)
COMMENTS = frozenset("comment comments respond disqus replies".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def words(attributes: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(attributes)}


@dataclass
class Line:
    """A run of text between block-level tags."""

    element: int  # number of the element it stands in
    left_out: bool
    tags: int = 0
    linked: int = 0
    text: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Open:
    """An element that isn't closed yet."""

    tag: str
    element: int  # its own number if it can hold a region, else its holder's
    left_out: bool
    why: str
    blocks: int  # block-level elements up to it
    paragraph: bool  # a paragraph is open, and no other block in it


class Lines(HTMLParser):
    """Lines of a page, and its holders: parent and tag of each. Every event takes constant time, on average over a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.tag = [-1], [""]
        self.stack: list[Open] = [Open("", 0, False, "", 0, False)]
        self.open: dict[str, list[int]] = {}  # places in the stack of each tag
        self.silent = self.links = 0
        self.line = Line(0, False)

    def broken(self) -> None:
        top = self.stack[-1]
        if self.line.text:
            self.lines.append(self.line)
        self.line = Line(top.element, top.left_out)

    def outside(self, tag: str, attributes: list[tuple[str, str | None]]) -> str:
        """Why an element is no part of an article; empty if it may be."""
        if tag == "form":
            return "form"
        if tag in ASIDE or tag == "header" and not any(self.open.get(r) for r in REGIONS):
            return tag
        if not attributes:
            return ""
        said = dict(attributes)
        names = words(f"{said.get('class') or ''} {said.get('id') or ''}")
        if names & COMMENTS:
            return "comments"
        if (said.get("role") or "").lower() in ROLES or "hidden" in said:
            return tag
        return "around" if names & AROUND and tag not in ("body", "html", *REGIONS) else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag in VOID:
            self.handle_void(tag)
            return
        if tag in ENDS_P and self.stack[-1].paragraph:
            self.handle_endtag("p")
        top = self.stack[-1]
        why = self.outside(tag, attrs)
        # A form round the whole page doesn't hide its article.
        left_out = bool(why) or (top.left_out and not (tag in REGIONS and top.why == "form"))
        element, block = top.element, tag in BLOCK
        if tag in HOLDERS:
            element = len(self.parent)
            self.parent.append(top.element)
            self.tag.append(tag)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Open(tag, element, left_out, top.why if top.left_out and left_out else why, top.blocks + block, tag == "p" or top.paragraph and not block))
        self.silent += tag in SILENT
        self.links += tag == "a"
        if block or left_out != top.left_out:
            self.broken()
        elif tag in SPACED:
            self.line.text.append(" ")

    def handle_void(self, tag: str) -> None:
        if tag == "hr":
            self.broken()
        elif tag == "br":
            self.line.text.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash of "<div/>" means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag == "br":
            self.handle_void(tag)
        if not self.open.get(tag):
            return
        at, top = self.open[tag][-1], self.stack[-1]
        if tag not in BLOCK and tag not in SILENT and top.blocks > self.stack[at].blocks:
            return  # an inline end doesn't close the blocks in between
        blocks = top.blocks
        while len(self.stack) > at:
            o = self.stack.pop()
            self.open[o.tag].pop()
            self.silent -= o.tag in SILENT
            self.links -= o.tag == "a"
        if blocks != self.stack[-1].blocks or top.left_out != self.stack[-1].left_out:
            self.broken()
        elif tag in SPACED:
            self.line.text.append(" ")

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.line.text.append(data)
        if self.links:
            self.line.linked += len(data)

    def close(self) -> None:
        if re.match("<[a-zA-Z/!?]", self.rawdata):
            self.rawdata = ""  # a tag or comment that the page ends in
        super().close()
        self.broken()


def contents(lines: list[tuple[Line, str]]) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio reaches the ratios' standard deviation. Lines of links only, or left out, have no ratio."""
    raw = np.array([0.0 if n.left_out else max(0, len(t) - 2 * n.linked) / (n.tags + 1) for n, t in lines])
    r = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(raw, r), kernel / kernel.sum(), "valid")
    return (smooth >= smooth.std()) & (raw > 0)


def region(parents: list[int], tags: list[str], lines: list[tuple[Line, str]], content: np.ndarray) -> np.ndarray:
    """Which lines belong to the region that the content lines point at."""
    # A holder's number is larger than its parent's: one walk sums up what holders hold.
    size, text = np.zeros(len(parents)), np.zeros(len(parents))
    for (n, t), c in zip(lines, content, strict=True):
        if not n.left_out:
            text[n.element] += len(t)
            size[n.element] += len(t) * bool(c)
    for i in range(len(parents) - 1, 0, -1):
        size[parents[i]] += size[i]
        text[parents[i]] += text[i]
    keep = np.array([not n.left_out for n, _ in lines], bool)
    for kind in ("article", "main"):
        inner = np.zeros(len(parents), np.int64)  # outermost element of this kind around each, or 0
        for i in range(1, len(parents)):
            inner[i] = inner[parents[i]] or (i if tags[i] == kind else 0)
        outer = [i for i in range(1, len(parents)) if inner[i] == i and text[i]]
        if outer:
            chosen = [i for i in outer if size[i]] or [max(outer, key=lambda i: text[i])]
            return keep & np.isin(inner[[n.element for n, _ in lines]], chosen)
    if not size[0]:
        return keep
    within = np.zeros(len(parents), bool)
    best = 0
    for i in range(1, len(parents)):
        if parents[i] == best and size[i] >= SHARE * size[0]:
            best = i
    within[best] = True
    for i in range(best + 1, len(parents)):
        within[i] = within[parents[i]]
    return keep & (within[[n.element for n, _ in lines]] | content)


def main_text(html: str) -> str:
    """The text of a page's content region: blocks in page order, white space in a block as one space, joined by line ends."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(n, t) for n in parser.lines if (t := " ".join("".join(n.text).split()))]
    if not lines:
        return ""
    chosen = region(parser.parent, parser.tag, lines, contents(lines))
    return "\n".join(t for (_, t), c in zip(lines, chosen, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    A map over partitions without a shuffle; a task holds one page's lines at a
    time. Null and empty pages, and pages without any content, give an empty
    text; repeated rows and null ids give a row each; broken markup is read as far
    as it goes (open elements end with those around them, or the page); further
    columns aren't read; no pages give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = mapped(pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html"), run, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
