"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered by a threshold."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

# What elements are.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html li main menu nav ol section table tbody td th thead tr ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd pre".split())
SILENT = frozenset("applet audio button canvas datalist embed head iframe map math noframes noscript object option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# The parts of a page that are never its article, by element, by role and by a word of class or id.
BOILERPLATE = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav navbar navigation newsletter pagination sidebar signup sponsor sponsored subscribe".split())
#: Standard deviation of the Gaussian over lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 0.5
#: Share of the mass of the main cluster that an element must hold to be its region.
REGION_SHARE = 0.8
#: Share of linked letters from which a line at the edge of a region is a link and no text.
LINK_SHARE = 0.6

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKENS = re.compile("[^a-z0-9]+")


class Line(NamedTuple):
    """One block's text, the tags since the line before, the letters in links, its container, and whether that is apart from the article."""

    text: str
    tags: int
    linked: int
    place: int
    apart: bool


class Lines(HTMLParser):
    """Parser events to lines: one for each block.  Containers are numbered as they open; ``parents`` has the one around each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.stack: list[tuple[str, bool, int]] = []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.silent = self.apart = self.within = 0
        self.silent_tag = ""

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.stack[-1][2] if self.stack else -1, self.apart > 0))
            self.tags = 0
        self.text, self.linked = [], 0

    def _boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BOILERPLATE or tag == "header" and not self.within:
            return True
        for name, value in attrs:
            if name in ("class", "id"):
                words = _TOKENS.split((value or "").lower())
                if not MARKS.isdisjoint(words) or "header" in words and not self.within:
                    return True
            elif name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value or ""):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            self.silent += tag == self.silent_tag
            return
        if tag in SILENT:
            if tag not in VOID:
                self.silent, self.silent_tag = 1, tag
            return
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()
            # An element that takes its exclusion from its own attributes, e.g. a paragraph of adverts, is a container for as long.
            apart = tag not in ("body", "html") and (tag in CONTAINERS or bool(attrs)) and self._boilerplate(tag, attrs)
            if tag not in CONTAINERS and self.stack and self.stack[-1][0] in LEAVES:
                self._pop()  # such an element ends where the next block begins
            if (tag in CONTAINERS or apart) and tag not in VOID:
                self.parents.append(self.stack[-1][2] if self.stack else -1)
                self.stack.append((tag, apart, len(self.kinds)))
                self.kinds.append(tag)
                self.open[tag] += 1
                self.apart += apart
                self.within += tag in ("article", "main")
        elif tag == "a":
            self.links = 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)
            if tag not in VOID and tag in CONTAINERS:
                self.handle_endtag(tag)

    def _pop(self) -> None:
        tag, apart, _ = self.stack.pop()
        self.open[tag] -= 1
        self.apart -= apart
        self.within -= tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent -= tag == self.silent_tag
            return
        self.tags += 1
        if tag == "a":
            self.links = 0
        elif tag in BLOCKS:
            self.flush()
            if self.open[tag]:
                while self.stack[-1][0] != tag:
                    self._pop()
                self._pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def ratios(lines: list[Line]) -> np.ndarray:
    """Text-to-tag ratio of each line; letters in links are no text."""
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=np.float64)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends nothing is added and weights are those of what is there."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    near = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[near] / np.convolve(np.ones(len(values)), kernel)[near]


def clusters(even: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of the runs of lines whose smoothed ratio reaches the threshold."""
    high = np.concatenate([[False], even >= max(THRESHOLD * float(even.std()), 1e-9), [False]])
    edges = np.flatnonzero(high[1:] != high[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def main_text(html: str) -> str:
    """The article of a page, one line for each block; see ``extract_text``."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, kinds, parents = parser.lines, parser.kinds, parser.parents
    if not any(not x.apart for x in lines):
        return ""
    # The mass of a line is its text times its smoothed ratio, in the cluster with the most of it; what is apart has none.
    even = smooth(ratios(lines))
    mass = np.array([0.0 if x.apart else len(x.text) * r for x, r in zip(lines, even, strict=True)])
    runs = clusters(even)
    first, last = max(runs, key=lambda r: (mass[r[0] : r[1]].sum(), -r[0]), default=(0, len(lines)))
    if not mass[first:last].sum():  # links only, or nothing but what is apart is dense
        first, last, mass = 0, len(lines), np.array([0.0 if x.apart else float(len(x.text)) for x in lines])
    held = [0.0] * len(kinds)
    for x, m in zip(lines[first:last], mass[first:last], strict=True):
        if x.place >= 0:
            held[x.place] += m
    for k in range(len(kinds) - 1, -1, -1):  # an element opens after the one around it
        if parents[k] >= 0:
            held[parents[k]] += held[k]
    need = REGION_SHARE * mass[first:last].sum() - 1e-9
    region = max((k for k in range(len(kinds)) if held[k] >= need), default=-1)  # a later one lies further in
    inside = [region < 0] * len(kinds)
    for k in range(max(region, 0), len(kinds)):
        inside[k] = k == region or inside[k] or parents[k] >= 0 and inside[parents[k]]
    kept = [k for k, x in enumerate(lines) if not x.apart and (inside[x.place] if x.place >= 0 else region < 0)]
    # Links at the edges of the region, outside the cluster, are menus.
    link = lambda k: lines[k].linked > LINK_SHARE * len(lines[k].text) and not first <= k < last
    text = [k for k in kept if not link(k)] or kept
    kept = [k for k in kept if text[0] <= k <= text[-1]]
    return "\n".join(lines[k].text for k in kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, from the whole html.

    Parser events give one line for each block.  Its text-to-tag ratio is smoothed over the
    neighbours by a Gaussian, and runs of lines above a threshold are clusters.  The cluster with
    the most text, weighted by its ratio, selects the region: the innermost element that holds most
    of it, whatever its name; links at its edges are left out.  All blocks of the region count, short ones too, but
    for the parts that the page itself names as none of the article, by an element, a role or a
    class: menus, headers, footers, sidebars, notices, adverts, forms, reader comments.

    Cases: null or empty html has empty text; html that is cut off, wrongly or deeply nested or
    plain text is read as far as it goes, however long; of clusters of equal mass the first counts, of
    elements the innermost; repeated rows are read alike; page_id and url may be null; extra
    columns are ignored; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = b.column("html")
            for k in range(0, b.num_rows, 256):
                texts = [main_text(h) if h else "" for h in html[k : k + 256].to_pylist()]
                part = b[k : k + 256]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
