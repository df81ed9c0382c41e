"""Main text of web pages from parser events and text-to-tag ratios."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickerloom.llm.arrow import kept_columns, map_batches

#: Spread and reach of the smoothing in lines, and the share of the ratios' deviation that divides the clusters.
SIGMA, REACH, SHARE = 1.0, 3, 1.0
#: Selected lines at most so far apart belong to one region.
GAP = 3
FEED = 1 << 20
# Element names of HTML by their role.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("""aside button canvas dialog footer form head iframe menu nav noscript object script select style svg
template textarea title audio video""".split())
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# Words in class, id and role attributes that mark page furniture.
FURNITURE = frozenset("""ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments
complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation
newsletter notice notification pagination paywall popup promo promoted related recommended replies respond search share
sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
_words = re.compile(r"[a-z]+")


class LineParser(HTMLParser):
    """Lines of a page: runs of text between block elements, with the number of tags before and inside each.

    Elements that never hold content, hidden ones and page furniture are left out with all they
    contain; a content element ends such a part, so an unclosed one does not swallow the article.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, content element, heading
        self.text: list[str] = []
        self.tags = self.content = self.opened = 0
        self.heading = False
        self.left: str | None = None
        self.depth = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.content, self.heading))
            self.tags = 0
        self.text = []

    def furniture(self, tag: str, attrs: list) -> bool:
        if tag in OUTSIDE:
            return True
        if tag in CONTENT or tag in ("html", "body"):
            return False
        if tag == "header" and not self.content:
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            value = (value or "").lower()
            if name in ("class", "id", "role") and not FURNITURE.isdisjoint(_words.findall(value)):
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.left is not None:
            if tag in CONTENT and self.left not in ("script", "style", "template", "noscript"):
                self.left = None
            else:
                self.depth += tag == self.left
                return
        if tag in BLOCKS:
            self.end_line()
        if tag not in VOID and self.furniture(tag, attrs):
            self.end_line()
            self.left, self.depth = tag, 1
            return
        if tag in CONTENT:
            self.opened += 1
            self.content = self.opened
        if tag in HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.left is None and tag in BLOCKS:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.left is not None:
            self.depth -= tag == self.left
            if self.depth == 0:
                self.left = None
            return
        if tag in BLOCKS:
            self.end_line()
        if tag in CONTENT:
            self.content = 0
        if tag in HEADINGS:
            self.heading = False

    def handle_data(self, data: str) -> None:
        if self.left is None:
            self.text.append(data)


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[REACH:REACH + len(ratios)]
    return np.convolve(ratios, kernel)[REACH:REACH + len(ratios)] / weight


def content_lines(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Which lines belong to content regions.

    Lines whose smoothed ratio reaches the threshold form the content cluster. A content element
    with such a line counts whole. On a page without one, regions are runs of such lines with the short gaps
    between them and the headings right before them.
    """
    ratio = smooth(np.array([len(t) / max(tags, 1) for t, tags, _, _ in lines]))
    part = np.array([c for _, _, c, _ in lines])
    high = ratio >= min(SHARE * ratio.std(), ratio.max())
    if part.any():
        return (part > 0) & np.isin(part, part[high & (part > 0)]) if (high & (part > 0)).any() else part > 0
    picked, before = high.copy(), None
    for i in np.flatnonzero(high):
        if before is not None and i - before <= GAP:
            picked[before:i] = True
        before = i
    for i in range(len(lines) - 2, -1, -1):
        picked[i] |= lines[i][3] and picked[i + 1]
    return picked


def main_text(html: str) -> str:
    parser = LineParser()
    for lo in range(0, len(html), FEED):
        parser.feed(html[lo:lo + FEED])
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    return " ".join(line[0] for line, good in zip(parser.lines, content_lines(parser.lines), strict=True) if good)


def extract(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars (code points) per row.

    The page is parsed as a stream of events. Blocks of text become lines; lines are chosen by
    their ratio of text to tags, smoothed over neighbours, and joined in page order by one space.
    A NULL or empty page, and one without content, gives an empty text. Rows with equal ids are
    taken each by itself. Input columns named like result columns are replaced.
    """
    keep = kept_columns(pages, keep, ["text", "n_chars"])
    rows = pages.select(*keep, F.col(html_col).alias("__html"))

    def work(batch: pa.RecordBatch):
        texts = [main_text(h.as_py() or "") for h in batch.column(len(keep))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=[*keep, "text", "n_chars"])

    return map_batches(rows, work, StructType([*rows.select(*keep).schema.fields, StructField("text", StringType()),
                                               StructField("n_chars", LongType())]))
