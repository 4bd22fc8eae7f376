"""Operator 6: main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each block of text, with the number of tags
that each line took and the containers it lies in. The ratio of text to tags of each line is smoothed with a Gaussian
over its neighbours; two-means clustering of the smoothed ratios gives the threshold of content lines. The content
region is the smallest container that holds nearly all text of those lines and outside of which there are only links and
lines of containers that HTML itself marks as something else; an article or main element that holds nearly all
may leave other text outside, but not that of another one. All lines of the region are the main text, short paragraphs and
headings too.

Elements, roles and names of classes that stand for boilerplate are hints. A hint does not hold for a container with the
page's main element, nor, but for reader comments, for one that has most of the text outside of links where most of that
is in long lines above the threshold and no article stands elsewhere. Lines in containers whose hint holds never count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.shared import free_name, table

SIGMA, REGION_SHARE = 1.0, 0.9
LONG_LINE = 60  # characters outside of links

# Elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split())
CONTAINERS = frozenset("article aside blockquote body center dialog div dl details fieldset figure footer form header html main menu nav ol search section table ul".split())
NEVER = frozenset("title script style noscript template iframe object svg math canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu search dialog".split())
HOME = frozenset(("article", "main"))
HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar widget".split())
COMMENTS = frozenset("comment comments commentlist respond".split())
# Words that stand beside such a word in the name of a class; beside others (no-comments, ad-free) it says nothing.
GENERIC = frozenset("area article articles bar block bottom box btn button buttons col column container content entry footer form global group head header icon icons inner item items left link links list main media module outer page panel post posts primary right secondary section site stories story title top wrap wrapper".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())


def _named(value: str) -> frozenset[str]:
    """Words for boilerplate in the names of a class or id attribute."""
    found: set[str] = set()
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words <= HINTS | GENERIC:
            found |= words & HINTS
    return frozenset(found)


class _Page(HTMLParser):
    """Lines of a page: text, tags, characters outside of links, and container; containers know their parent, tag and hint (1:
    boilerplate, 2: comments)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.free, self.link = 0, 0  # free: characters of the line outside of links; link: number of open containers at the start of the open link
        self.parents, self.tags, self.hints = [-1], ["#page"], [0]
        self.open: list[int] = [0]
        self.n_open: Counter[str] = Counter()  # open containers by tag
        self.never: list[str] = []
        self.parts: list[str] = []
        self.n_tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, self.n_tags, min(self.free, len(text)), self.open[-1]))
            self.n_tags = 0
        self.free = 0

    def _hint(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in BOILERPLATE:
            return 1
        if tag == "header":
            return int(not any(self.n_open[t] for t in HOME))
        if tag in ("html", "body", "main"):
            return 0
        hint = 0
        for name, value in attrs:
            if name in ("class", "id") and value:
                words = _named(value)
                hint = max(hint, 2 if words & COMMENTS else int(bool(words)))
            elif name == "role" and value and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                hint = max(hint, 1)
        return hint

    def _leave(self, tag: str) -> None:
        """Close the innermost open container of the tag, and those in it for good: all end tags take linear time."""
        closed = ""
        while closed != tag:
            closed = self.tags[self.open.pop()]
            self.n_open[closed] -= 1
        if self.link > len(self.open):  # a link ends with the container it began in
            self.link = 0

    def handle_starttag(self, tag, attrs):
        self.n_tags += 1
        if self.never:
            if tag == self.never[-1]:
                self.never.append(tag)
            return
        if tag in NEVER:
            self.never.append(tag)
            return
        if tag in BLOCKS:
            self._end_line()
            for left_open in ("nav", "header", *(("aside", "footer") if tag == "main" else ())) if tag in HOME else ():
                while self.n_open[left_open]:  # none of these holds the main part of a page: it was never closed
                    self._leave(left_open)
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = len(self.open) if any(name == "href" for name, _ in attrs) else 0
        hint = self._hint(tag, attrs) if tag in BLOCKS and tag not in ("hr", "p") else 0
        if tag in CONTAINERS or hint:
            self.parents.append(self.open[-1])
            self.tags.append(tag)
            self.hints.append(hint)
            self.open.append(len(self.parents) - 1)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in NEVER:
            self.n_tags += 1
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.n_tags += 1
        if self.never:
            if tag == self.never[-1]:
                self.never.pop()
            elif tag in ("body", "html"):
                self.never.clear()
            return
        if tag in BLOCKS:
            self._end_line()
        elif tag == "a":
            self.link = 0
        if self.n_open[tag]:
            self._leave(tag)

    def handle_data(self, data):
        if not self.never:
            self.parts.append(data)
            if not self.link and any(c.isalnum() for c in data):
                self.free += len(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut off and normalised."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Midpoint of two one-dimensional means; below all values if they don't differ."""
    low, high = values.min(), values.max()
    if high <= low:
        return low - 1
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above):  # they differ by rounding only
            break
        new = below.mean(), above.mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _summed(values: np.ndarray, parents: list[int]) -> np.ndarray:
    """Of each container, its own value and those of all in it; a container comes after its parent."""
    for i in range(len(values) - 1, 0, -1):
        values[parents[i]] += values[i]
    return values


def _boilerplate(page: _Page) -> np.ndarray:
    """Whether each container is boilerplate: where it or one around it has a hint that holds."""
    n, at = len(page.parents), np.array([c for *_, c in page.lines])
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, _, _ in page.lines]))
    free = np.array([f for _, _, f, _ in page.lines], float)
    long = (ratios > threshold(ratios)) & (free >= LONG_LINE)
    text, body = (_summed(np.bincount(at, w, n), page.parents) for w in (free, free * long))
    mains, homes = (_summed(np.array([float(t in tags and text[i] > 0) for i, t in enumerate(page.tags)]), page.parents) for tags in (("main",), HOME))
    out = np.zeros(n, bool)
    for i in range(1, n):
        most = page.hints[i] == 1 and 2 * text[i] >= text[0] and 2 * body[i] >= text[i] and (homes[i] > 0 or homes[0] == 0)
        out[i] = out[page.parents[i]] or page.hints[i] > 0 and not mains[i] and not most
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by an empty line; empty if there is none."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end_line()
    if not page.lines:
        return ""
    boilerplate = _boilerplate(page)
    lines = [(text, tags, bool(boilerplate[at]), at) for text, tags, _, at in page.lines]
    if not any(not boiler for _, _, boiler, _ in lines):
        return ""
    ratios = np.array([0.0 if boiler else len(text) / max(1, tags) for text, tags, boiler, _ in lines])
    soft = smoothed(ratios)
    cut = threshold(soft)
    n = len(page.parents)
    weight, home, plain = np.zeros(n), np.zeros(n), np.zeros(n)
    for (text, _, boiler, at), s, (_, _, free, _) in zip(lines, soft, page.lines):
        if not boiler:
            home[at] += len(text)
            weight[at] += len(text) * (s > cut)
            plain[at] += free > 0
    if not weight.any():
        weight = home
    weight, plain = _summed(weight, page.parents), _summed(plain, page.parents)
    own_weight, own_plain = (np.where([t in HOME for t in page.tags], x, 0.0) for x in (weight, plain))  # in article and main
    for i in range(n - 1, 0, -1):
        if page.tags[page.parents[i]] not in HOME:
            own_weight[page.parents[i]] += own_weight[i]
            own_plain[page.parents[i]] += own_plain[i]
    inner: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        inner[page.parents[i]].append(i)
    region = 0
    while page.tags[region] not in HOME:
        best = max(inner[region], key=lambda i: weight[i], default=None)
        if best is None or weight[best] < REGION_SHARE * weight[region] or page.tags[best] in ("ul", "ol", "dl", "table", "blockquote", "figure"):
            break
        marked = own_weight[best] >= REGION_SHARE * weight[region] and own_plain[best] == own_plain[region]
        if not marked and plain[best] < plain[region]:  # text would be lost
            break
        region = best
    inside = np.zeros(n, bool)
    inside[region] = True
    for i in range(region + 1, n):
        inside[i] = inside[page.parents[i]]
    return "\n\n".join(text for text, _, boiler, at in lines if inside[at] and not boiler)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
        yield pa.record_batch([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "main_text"])


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages``, without its html, with main_text added (it replaces a column of that name).

    Null and empty pages give an empty text, and so do pages of menus and the like alone. White space in a block becomes
    one space, character references are decoded, unclosed and unmatched tags are borne. Pages are parsed whole, in time in proportion to their
    length however deep their elements are nested. Repeated rows are extracted alike; an empty table gives an empty result.
    """
    own = pages.drop("main_text")
    scanned = free_name(own, "_html")
    own = own.withColumn(scanned, F.col(html_col)).drop(html_col)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop(scanned).schema.fields)
    return own.mapInArrow(_extract, f"{spec}{', ' if spec else ''}main_text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text (the main text) and n_chars of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
