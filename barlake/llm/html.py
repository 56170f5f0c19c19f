"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard-library parser is fed once per page and never builds a tree. Its events cut the page into lines: a line
is a run of text between block tags, with the number of tags seen since the line before and what encloses it. Lines
inside elements that never hold an article's text (menus, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, styles, comments) are boilerplate whatever their ratio. The ratios of the other lines are
smoothed with a Gaussian kernel and split at a threshold of the page's own spread; runs of lines above the threshold
are content regions. Where the page marks an article, only lines inside it count, and the marks decide about its low
lines (see `_marked`): headings, paragraphs and plain lines between content lines stay, links and runs of tags go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlake.llm.common import columns

# Elements of HTML by role.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style noscript template nav aside footer form button select option iframe svg canvas object head title dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Names in class, id or role that mark boilerplate, as whole words between other characters.
NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|widget\w*|related|recommend\w*|share|sharing|social|footer|masthead|"
    r"comments?|disqus|replies|respond|login|signup|search\w*|toolbar|pagination|pager|skip-link|complementary|contentinfo|navigation)(?:$|[^a-z])"
)
#: One of these names as a whole class or id marks the element itself; inside a longer name it may only describe a page layout.
WHOLE = re.compile(rf"(?:{NOISE.pattern[len('(?:^|[^a-z])(?:') : -len(')(?:$|[^a-z])')]})")
COMMENT = re.compile(r"(?:^|[^a-z])(?:comments?|replies|reply|respond|disqus)(?:$|[^a-z])")
SENTENCE = re.compile(r"[.!?\u2026\u3002][\"'\u201d\u2019)\]]*$")
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Blocks that hold prose: their short lines are part of a marked article.
PROSE = frozenset("article blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li main p pre td th".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SPACES = re.compile(r"\s+")


@dataclass
class Line:
    """A run of text outside boilerplate: tags since the text before, number of its article or main region (0: none).

    `block` is the innermost open block, `linked` the share of its characters inside links, `inline` the inline tags in it.
    """

    text: str
    tags: int
    region: int
    block: str
    linked: float
    inline: int


@dataclass
class Open:
    """An open element: `strong` boilerplate whatever it holds, `weak` unless it holds an article or main region.

    `outer` is the count of weak marks around a region, which do not count inside it.
    """

    tag: str
    strong: bool
    weak: bool
    region: bool
    outer: int


class Lines(HTMLParser):
    """Lines of a page from the parser's events. Text inside boilerplate never joins a line around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        # Places in `open` of each tag's open elements, and of the open blocks.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.strong = self.weak = self.depth = self.regions = self.region = self.tags = 0
        self.held: list[str] = []
        self.noise = False
        self.linked = self.inline = 0
        self.link = False

    def cut(self):
        text = SPACES.sub(" ", "".join(self.held)).strip()
        self.held = []
        if text:
            block = self.open[self.blocks[-1]].tag if self.blocks else ""
            linked = self.linked / len(SPACES.sub("", text)) if self.linked else 0.0
            self.lines.append(Line(text, self.tags, self.region if self.depth else 0, block, linked, self.inline))
        if text or self.noise:
            self.tags = 0
        self.linked = self.inline = 0
        self.noise = False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag not in BLOCKS:
            self.inline += 1
        if tag in ENDS_P:
            self._close_paragraph()
        elif tag in ("li", "td", "th", "tr", "option", "dt", "dd") and self.open and self.open[-1].tag == tag:
            self._pop()
        names = [value.lower() for name, value in attrs if value and name in ("class", "id", "role", "aria-label")]
        region = (tag in ("article", "main") or "main" in [v.lower() for n, v in attrs if n == "role" and v]) and not any(COMMENT.search(n) for n in names)
        noisy = any(NOISE.search(n) for n in names)
        strong = tag in SKIPPED and tag != "form" or tag == "header" and self.depth == 0 or any(name == "hidden" for name, _ in attrs)
        strong |= tag == "article" and not region or noisy and any(WHOLE.fullmatch(word) for n in names for word in n.split())
        weak = tag == "form" or noisy
        if region or tag in ("body", "html"):
            strong = weak = False
        outer = self.weak
        if region:
            if not self.depth:
                self.regions += 1
                self.region = self.regions
            self.depth += 1
            self.weak = 0
        self.strong += strong
        self.weak += weak
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(Open(tag, strong, weak, region, outer))
        if tag == "a":
            self.link = any(name == "href" for name, _ in attrs)

    def _pop(self):
        last = self.open.pop()
        self.places[last.tag].pop()
        if last.tag in BLOCKS:
            self.blocks.pop()
        self.strong -= last.strong
        self.weak = last.outer
        self.depth -= last.region
        if last.tag == "a":
            self.link = False

    def _pop_to(self, place):
        while len(self.open) > place:
            self._pop()

    def _close_paragraph(self):
        """A block start closes an open paragraph with the inline elements left open in it."""
        if self.blocks and self.open[self.blocks[-1]].tag == "p":
            self._pop_to(self.blocks[-1])

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        else:
            self.inline += 1
        self.tags += 1
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def handle_data(self, data):
        if self.strong or self.weak:
            self.noise |= not data.isspace()
            return
        self.held.append(data)
        if self.link:
            self.linked += len(SPACES.sub("", data))


def page_lines(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.lines


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian kernel of radius ceil(sigma), normalised at the ends."""
    reach = int(np.ceil(sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def _marked(lines: list[Line], above: np.ndarray, own: np.ndarray) -> list[bool]:
    """Which lines of one marked region stay; none where no line is content.

    A line mostly of links that is no sentence of its own, or outside prose with more inline tags than words, must reach the threshold by its `own`
    ratio, as smoothing lifts it beside a long paragraph. The other lines are content if they are `above`. Of those that
    are not, lines of prose blocks stay, and others between content lines. A heading goes with what it heads: it is
    dropped if it leads two or more dropped lines or none but dropped ones, or is a link that leads no kept text; the
    page's own heading (h1) stays.
    """
    heads = [line.block in HEADINGS for line in lines]
    linked = [line.linked > 0.5 and not (line.block == "p" and SENTENCE.search(line.text)) for line in lines]
    loose = [not head and (links or line.block not in PROSE and line.inline > len(line.text.split())) for head, links, line in zip(heads, linked, lines)]
    content = [bool(o if l else a) for a, o, l in zip(above, own, loose)]
    body = [k for k, c in enumerate(content) if c and not heads[k]]
    if not body:
        return content
    first, last = body[0], body[-1]
    keep = [c or not l and (line.block in PROSE or first < k < last) for k, (c, l, line) in enumerate(zip(content, loose, lines))]
    dropped = 0
    for k in range(len(lines) - 1, -1, -1):
        if heads[k]:
            follows = k + dropped + 1 < len(lines)
            keep[k] = lines[k].block == "h1" or not dropped or dropped == 1 and follows
            if lines[k].block != "h1" and lines[k].linked > 0.5:
                keep[k] = follows and not dropped and not heads[k + 1]
        dropped = 0 if keep[k] else dropped + 1
    return keep


def main_text(html: str, sigma: float = 1.0, share: float = 0.25) -> str:
    """Content lines in page order, joined by one newline.

    The threshold is `share` of the smoothed ratios' standard deviation (of their mean where all are alike).
    """
    lines = page_lines(html)
    if any(line.region for line in lines):
        lines = [line for line in lines if line.region]
    if not lines:
        return ""
    ratio = np.array([len(line.text) / max(1, line.tags) for line in lines])
    level = smooth(ratio, sigma)
    spread = level.std()
    least = share * spread if spread > 0 else 0.0
    above, own = level >= least, ratio >= least
    if lines[0].region:
        regions = np.array([line.region for line in lines])
        cuts = [0, *(np.flatnonzero(np.diff(regions)) + 1), len(lines)]
        above = [keep for a, b in zip(cuts, cuts[1:]) for keep in _marked(lines[a:b], above[a:b], own[a:b])]
    return "\n".join(line.text for line, keep in zip(lines, above) if keep)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, sigma: float = 1.0, share: float = 0.25) -> DataFrame:
    """Main text of every page row. Null html counts as empty and gives empty text; the whole html is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma, share) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return columns(pages, "page_id", "url", "html").mapInArrow(rows, SCHEMA)
