"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events; block boundaries end a line, and every line gets its text, its number of
tags and the section it stands in.  The ratio of text to tags per line is smoothed with a Gaussian, and lines are
clustered into content and the rest by the threshold that splits the smoothed ratios best (least squares within
both clusters).  Every article or main section that holds a content line is kept whole and in page order, and so are the
headings and paragraphs of a main section around such an article.  Where no section holds content,
or most of it stands outside them, the region reaches
from the first to the last content line of the page, and on over the headings and paragraphs next to it.  Short lines in
a region (headings, one-word paragraphs) belong to it.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are known by element, role, class or id; their
lines keep their tags but lose their text, so they pull the ratios around them down and never enter the result.  Scripts,
styles and templates are not text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: elements of the HTML standard by their part on a page, and names that sites give to such parts
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = set("script style noscript template head title iframe object svg canvas select textarea button".split())
TEXTUAL = set("h1 h2 h3 h4 h5 h6 p".split())
CHROME = set("nav aside footer form menu dialog".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
CHROME_NAMES = set(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pagination popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription teaser toolbar widget".split()
)
# a block start ends an open paragraph, and an item or cell ends the one before it
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

SIGMA = 1.0


class _Lines(HTMLParser):
    """Collects (text, tags, section, block) per line; text of left-out parts is dropped, their tags still count."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # element, its text is left out, number of its article or main
        self.lines: list[tuple[str, int, int, str]] = []
        self.text: list[str] = []
        self.tags = 0
        self.sections: list[str] = [""]
        self.inside: list[int] = [0]  # number of the section around each

    def state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            block = next((name for name, _, _ in reversed(self.open) if name in BLOCKS), "")
            self.lines.append((text, self.tags, self.state()[1], block))
        self.text, self.tags = [], 0

    def close_to(self, at: int) -> None:
        self.flush()
        del self.open[at:]

    def close_before(self, tag: str) -> None:
        """End what a start of `tag` ends by itself."""
        if tag == "body":
            self.close_to(next((i for i, (name, _, _) in enumerate(self.open) if name == "head"), len(self.open)))
            return
        names = ENDS.get(tag, set())
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == "p" or name in names:
                self.close_to(at)
            elif name in BLOCKS:
                return

    def left_out(self, tag: str, attrs: dict[str, str | None], section: int) -> bool:
        if tag in OPAQUE or tag in CHROME or tag == "header" and not section or "hidden" in attrs:
            return True
        if (attrs.get("role") or "").lower() in CHROME_ROLES:
            return True
        words = set(re.split(r"[^a-z]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        return tag not in ("html", "body", "main") and bool(words & CHROME_NAMES)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.close_before(tag)
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        out, section = self.state()
        out = out or self.left_out(tag, dict(attrs), section)
        if not out and (tag == "main" or tag == "article" and self.sections[section] != "article"):
            self.sections.append(tag)
            self.inside.append(section)
            section = len(self.sections) - 1
        self.open.append((tag, out, section))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:  # HTML ignores the slash on blocks
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                if tag in BLOCKS:
                    self.close_to(at)
                else:
                    del self.open[at:]
                return
            if name in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag does not end a block

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.text.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    # ends see only the lines there are
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which smoothed ratios lie above the threshold that splits them best; all, if they are all alike."""
    values = np.sort(ratios)
    if len(values) < 2 or values[0] == values[-1]:
        return np.ones(len(ratios), bool)
    sums, n = np.cumsum(values)[:-1], np.arange(1, len(values))
    total = values.sum()
    between = sums**2 / n + (total - sums) ** 2 / (len(values) - n)
    between[values[1:] == values[:-1]] = -1.0  # equal values stay together
    return ratios > values[int(np.argmax(between))]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of one page, its blocks joined by newlines."""
    parser = _Lines()
    parser.feed(html or "")
    # what the parser still holds is unfinished; a tag or comment cut off at the end is not text
    if not parser.cdata_elem and re.match(r"<[a-zA-Z/!?]|<$", parser.rawdata):
        parser.rawdata = ""
    parser.close()
    parser.flush()
    lines = parser.lines
    filled = [i for i, line in enumerate(lines) if line[0]]
    if not filled:
        return ""
    content = content_lines(smooth(np.array([len(text) / max(1, tags) for text, tags, _, _ in lines]), sigma))
    holding = {lines[i][2] for i in filled if content[i]} - {0}
    beside = sum(len(lines[i][0]) for i in filled if content[i] and not lines[i][2])
    if 2 * beside > sum(len(lines[i][0]) for i in filled if content[i]):  # most content stands in no section
        holding = set()
    elif not holding:  # nothing stands out: sections with text, or all
        holding = {lines[i][2] for i in filled} - {0}
    if holding:
        around = set()  # main sections with content in a section inside them
        for section in holding:
            while section := parser.inside[section]:
                around.add(section)
        around = {section for section in around if parser.sections[section] == "main"}
        chosen = [i for i in filled if lines[i][2] in holding or lines[i][2] in around and lines[i][3] in TEXTUAL]
    else:
        picked = [i for i in filled if content[i]] or filled
        first, last = filled.index(picked[0]), filled.index(picked[-1])
        while first > 0 and lines[filled[first - 1]][3] in TEXTUAL:
            first -= 1
        while last + 1 < len(filled) and lines[filled[last + 1]][3] in TEXTUAL:
            last += 1
        chosen = filled[first : last + 1]
    return "\n".join(lines[i][0] for i in chosen)


def extract(html: Column, sigma: float = SIGMA) -> Column:
    """The main text of a column of pages; NULL and pages without text give the empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(page.as_py(), sigma) for page in pages], pa.string())

    return run.asNondeterministic()(html)


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = SIGMA
) -> DataFrame:
    """Per row of `pages`: id, url, text, n_chars.

    NULL html counts as empty; ids and urls may be NULL or repeat; other columns are not read; an empty table gives an
    empty result.
    """
    return pages.select(id_col, url_col, extract(F.col(html_col), sigma).alias("text")).select(
        id_col, url_col, "text", F.char_length("text").cast("long").alias("n_chars")
    )
