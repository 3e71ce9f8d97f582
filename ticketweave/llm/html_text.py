"""Main text of web pages: parser events become lines, and the ratio of text to tags tells content from the rest.

The standard library's parser streams start tags, data and end tags. Each block element starts a line; a line knows its
characters, its tags (but for emphasis) and the region it stands in (an article, the main part, or the body). Elements that never hold main
text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments) are left out by name, role or
class. Ratios of the other lines are smoothed with a Gaussian, two clusters give the threshold; lines of a marked region count
for more, its headings and lines with no tags but a block's own are content. Regions of any kind compete by their text of
content: the best one and those near it are kept, each from its first to its last line of content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol "
                  "optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
EMPHASIS = frozenset("abbr b cite code em i mark q s small strong sub sup u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and name parts that mark anything but main text.
SKIPPED = frozenset("aside audio button canvas dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title video".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
SKIPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer gdpr header masthead menu modal "
                          "nav navbar navigation newsletter notice notices pagination pager popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored "
                          "subscribe subscription toc toolbar widget".split())
#: How much more a line counts that stands in an article or main part, and the share of the best region's content that takes
#: another region along.
PRIOR, SHARE = 4.0, 0.5
KEPT = frozenset("html body main article".split())
CLOSED_BY_BLOCK = frozenset("p".split())
_NEGATED = re.compile(r"\b(?:no|has|with|without)[-_](?:\w+)")
_MARKED = re.compile(r"<!\[[^>]*>")


def _names(value: str | None) -> set[str]:
    return set(re.split(r"[^a-z]+", _NEGATED.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value or "").lower())))


class LineParser(HTMLParser):
    """Streams a page into lines (region, text, tags, heading); regions are numbered, 0 is what stands in no article or main part."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str, int, bool]] = []
        self.kinds = [""]
        self._open: list[tuple[str, bool, int]] = []
        self._held: Counter[str] = Counter()  # open elements by name
        self._skip = self._region = self._tags = 0
        self._heading = False
        self._text: list[str] = []

    def _line(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.lines.append((self._region, text, self._tags, self._heading))
                self._tags = 0
            self._text = []

    def _pop(self) -> None:
        tag, skipped, region = self._open.pop()
        self._held[tag] -= 1
        self._skip -= skipped
        self._region = region

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._line()
            self._heading = tag in HEADINGS
            if self._open and self._open[-1][0] in CLOSED_BY_BLOCK and tag != "br":
                self._pop()
        counted = not self._skip and tag not in EMPHASIS
        self._tags += counted
        if tag in VOID:
            return
        given = dict(attrs)
        in_article = self.kinds[self._region] == "article"
        skipped = tag in SKIPPED or (tag == "header" and not in_article) or "hidden" in given or (given.get("role") or "").lower() in SKIPPED_ROLES
        if attrs and (tag not in KEPT and tag not in HEADINGS or tag == "article" and in_article):
            named = (_names(given.get("class")) | _names(given.get("id"))) & SKIPPED_NAMES
            skipped = skipped or bool(named) and not (in_article and named == {"header"})
        if skipped and counted:
            self._tags -= 1  # what is left out says nothing about the line after it
        self._open.append((tag, skipped, self._region))
        self._held[tag] += 1
        self._skip += skipped
        if tag in ("article", "main") and not self._skip and not in_article:
            self.kinds.append(tag)
            self._region = len(self.kinds) - 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self._line()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._line()
            self._heading = False
        if not self._skip and tag not in EMPHASIS:
            self._tags += 1
        if self._held[tag]:
            while self._open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self._skip:
            self._text.append(data)

    def finish(self) -> None:
        self.close()
        self._line()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius:radius + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint of two clusters of the values' logarithms; equal values are all content."""
    logs = np.sort(np.log1p(values))
    sums, n, at = np.concatenate([[0.0], np.cumsum(logs)]), len(logs), -1
    low, high = float(logs[0]), float(logs[-1])
    if high <= low:
        return float(values.min())
    while True:  # two means in one dimension: stops when the cut stays where it is
        found = int(np.searchsorted(logs, (low + high) / 2))
        if found == at or found in (0, n):
            return float(np.expm1((low + high) / 2))
        at, low, high = found, float(sums[found] / found), float((sums[n] - sums[found]) / (n - found))


def main_text(html: str | None, sigma: float = 1.5) -> str:
    """The article of one page; empty where the page is null or shows no text."""
    parser = LineParser()
    parser.feed(_MARKED.sub(" ", html or ""))
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    level = smoothed(np.array([len(text) / max(1, tags) for _, text, tags, _ in lines]), sigma)
    marked = np.array([region > 0 for region, _, _, _ in lines])
    content = (level * np.where(marked, PRIOR, 1.0) >= threshold(level)) | marked & np.array([heading or tags <= 2 for _, _, tags, heading in lines])
    scores = [0] * len(parser.kinds)
    for (region, text, _, _), is_content in zip(lines, content):
        scores[region] += len(text) if is_content else 0
    spans = {}
    for at in np.flatnonzero(content):
        region = lines[at][0]
        if scores[region] >= SHARE * max(scores):
            spans[region] = spans.get(region, (at, at))[0], at
    return " ".join(text for at, (region, text, _, _) in enumerate(lines) if region in spans and spans[region][0] <= at <= spans[region][1])


def extract_main_text(html: Column) -> Column:
    """Column of main texts; pages are parsed one at a time, an Arrow batch holds a bounded number of them."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text, na_action=None)

    return extract(html)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page, or one without main text, gives an empty text; nothing is cut. Rows that repeat are read each.
    """
    text = extract_main_text(F.col(html))
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
