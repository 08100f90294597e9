"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams events; block elements cut the text into lines. A line
knows its characters, its tags and the element it stands in; an element knows its parent. The
lines' text-to-tag ratios are smoothed by a Gaussian, and a threshold of their spread splits
lines into content and rest.

Some elements are boilerplate by their meaning. A role, class or id that usually stands for it, or a
form around the text, is a hint, which the ratios can overrule: a hinted element does not count as boilerplate if articles or main elements inside it hold half of
the content, nor, where less than OPEN of the content stands outside all hinted elements, if it
holds more than half of the content itself (outermost first, until enough is open). Lines of all
other hinted elements are left out and lower the ratios around them. Where an article or main
element with content stands outside all hints, no hint is overruled by its share, so that comments
longer than a short article do not replace it.

Content lines then vote for the region they stand in, the innermost article or main element.
Regions with at least REGION of the content are the text; otherwise it is the element whose lines
hold most content. All lines of the region that are not boilerplate are kept, so that short lines
between long ones stay.

Pages are independent, and the parser is fed whole pages one at a time; nothing is shuffled. Time
and memory grow with the length of a page, however deep its elements are nested.

Defined results: null and empty pages, and pages without content, have the empty text. Unclosed
elements end with their parents; a paragraph ends where a block starts. Hidden elements are never
text. Repeated rows are treated alike. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from odflux.llm.common import table
from odflux.llm.registry import query

# Elements of HTML by what they mean for text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head script style noscript template svg math iframe object canvas audio video select textarea button title".split()
)
BOILERPLATE = frozenset("nav aside footer dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side aside "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus "
    "replies share sharing social related recommended pagination pager toolbar widget search form hidden".split()
)
REGIONS = frozenset(("article", "main"))
CLOSES_PARAGRAPH = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset(("ul", "ol", "dl", "table"))
_WORDS = re.compile(r"[^a-z]+")
SIGMA = 1.0
SPREAD = 0.5  # standard deviations
OPEN = 0.2  # share of the content outside hinted elements, below which hints are overruled
REGION = 0.25  # share of the content that articles and main elements need
NOWHERE = -1
HINT, FIRM = 1, 2


class _Lines(HTMLParser):
    """Collects lines, [parts of text, tags, element], and elements, whose parents come first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.line: list | None = None
        # Of each element: its parent, whether it is hinted, whether it or one around it is hidden,
        # and the innermost article or main element it is or stands in.
        self.parent: list[int] = []
        self.hinted: list[int] = []
        self.hidden: list[bool] = []
        self.region: list[int] = []
        # Open elements: (name, element, skipped, then the places in this list of the last block,
        # the last block that is no paragraph, and the last list), and the places of each name.
        self.open: list[tuple[str, int, bool, int, int, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def _cut(self) -> None:
        if self.line is not None and self.line[0]:
            self.lines.append(self.line)
        self.line = None

    def _tag(self) -> None:
        if self.line is not None:
            self.line[1] += 1

    @staticmethod
    def _judge(tag: str, attrs: list, inside: bool) -> tuple[int, bool]:
        """Whether an element is boilerplate (FIRM) or hinted to be, and whether it is hidden."""
        hint = FIRM if tag in BOILERPLATE or tag == "header" and not inside else HINT if tag == "form" else 0
        hidden = False
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
            elif name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name == "role" and value in ROLES:
                hint = max(hint, HINT)
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                words = set(_WORDS.split(value))
                if words & NAMES and not (inside and words & NAMES == {"header"}):
                    hint = max(hint, HINT)
        return hint, hidden

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self._cut()
            elif tag == "br":
                self.handle_data(" ")
            self._tag()
            return
        if tag == "body":
            while self.open and self.open[-1][0] == "head":
                self._pop(len(self.open) - 1)
        if tag in CLOSES_PARAGRAPH:
            self._close("p", 4)
        if tag in SIBLINGS:
            for other in SIBLINGS[tag]:
                self._close(other, 5)
        if tag in BLOCKS:
            self._cut()
        _, above, skipped, block, solid, inner = self.open[-1] if self.open else ("", NOWHERE, False, NOWHERE, NOWHERE, NOWHERE)
        region = self.region[above] if above != NOWHERE else NOWHERE
        hint, hidden = self._judge(tag, attrs, region != NOWHERE)
        element, place = len(self.parent), len(self.open)
        self.parent.append(above)
        self.hinted.append(hint)
        self.hidden.append(hidden or above != NOWHERE and self.hidden[above])
        self.region.append(element if tag in REGIONS else region)
        self.open.append((
            tag, element, skipped or tag in SKIPPED, place if tag in BLOCKS else block,
            place if tag in BLOCKS and tag != "p" else solid, place if tag in LISTS else inner,
        ))
        self.places[tag].append(place)
        self._tag()

    def _pop(self, place: int) -> None:
        """Ends the open elements from a place on."""
        for name, *_ in self.open[place:]:
            self.places[name].pop()
        del self.open[place:]

    def _close(self, tag: str, barrier: int | None) -> None:
        """Ends the innermost such element, unless the last barrier stands behind it. A barrier is a
        column of ``open``."""
        if not self.places[tag]:
            return
        place = self.places[tag][-1]
        if barrier is not None and self.open[-1][barrier] > place:
            return
        if self.open[-1][3] >= place:
            self._cut()
        self._pop(place)

    def handle_endtag(self, tag: str) -> None:
        self._tag()
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag in BLOCKS:
            self._cut()
            self._close(tag, None)
        else:
            # An inline end tag does not end blocks around it.
            self._close(tag, 3 if tag not in SKIPPED else None)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = [[], 1, self.open[-1][1] if self.open else NOWHERE]
        self.line[0].append(data)


def _smoothed(values: list[float]) -> list[float]:
    reach = math.ceil(3 * SIGMA)
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def _content(sizes: list[int], tags: list[int], bad: list[bool]) -> list[bool]:
    """Which lines are content by their smoothed ratios. Bad lines count as empty."""
    ratio = _smoothed([0.0 if b else n / t for n, t, b in zip(sizes, tags, bad)])
    mean = sum(ratio) / len(ratio)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    limit = min(SPREAD * spread, max(ratio))
    return [not b and r >= limit for b, r in zip(bad, ratio)]


def _sums(parent: list[int], own: list[int]) -> list[int]:
    """Of each element, what it and all elements inside it have."""
    out = own[:]
    for e in range(len(parent) - 1, -1, -1):
        if parent[e] != NOWHERE:
            out[parent[e]] += out[e]
    return out


def _boilerplate(page: _Lines, sizes: list[int], tags: list[int]) -> list[bool]:
    """Of each element, whether a hint on it or on an element around it stands."""
    parent, count = page.parent, len(page.parent)
    core = _content(sizes, tags, [e != NOWHERE and page.hidden[e] for _, _, e in page.lines])
    total, outside, clear = 0, 0, False
    own, named = [0] * count, [0] * count
    for (_, _, e), n, is_core in zip(page.lines, sizes, core):
        if is_core:
            total += n
            if e == NOWHERE:
                outside += n
                continue
            own[e] += n
            if page.region[e] != NOWHERE:
                named[e] += n
    held, regions = _sums(parent, own), _sums(parent, named)
    stands = [
        hint == FIRM or hint == HINT and (page.region[e] != NOWHERE or 2 * regions[e] < total or not total)
        for e, hint in enumerate(page.hinted)
    ]
    # An article or main element outside all hints stays what it is, however short.
    around = [False] * count
    for e in range(count):
        around[e] = stands[e] or parent[e] != NOWHERE and around[parent[e]]
        clear = clear or bool(named[e]) and not around[e]
    if clear:
        return around
    # Elements with more than half of the content lie on one path from the outermost one. Below
    # each of its hints, so much content has no other hint.
    opened: dict[int, int] = defaultdict(int, {0: outside})
    depth, off = [0] * count, [False] * count
    path: list[int] = []
    for e in range(count):
        above = parent[e]
        if above != NOWHERE:
            depth[e], off[e] = depth[above], off[above]
        if stands[e]:
            if 2 * held[e] > total and page.hinted[e] == HINT:
                path.append(e)
                depth[e] += 1
            else:
                off[e] = True
        if not off[e]:
            opened[depth[e]] += own[e]
    free = 0
    for k in range(len(path) + 1):
        free += opened[k]
        if free >= OPEN * total:
            break
        if k < len(path):
            stands[path[k]] = False
    for e in range(count):
        if parent[e] != NOWHERE:
            stands[e] = stands[e] or stands[parent[e]]
    return stands


def main_text(page: str) -> str:
    """Blocks of the main region, two line ends between them."""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser._cut()
    texts = [" ".join("".join(parts).split()) for parts, _, _ in parser.lines]
    parser.lines = [line for line, text in zip(parser.lines, texts) if text]
    texts = [text for text in texts if text]
    if not texts:
        return ""
    sizes, tags = [len(t) for t in texts], [t for _, t, _ in parser.lines]
    place = [e for _, _, e in parser.lines]
    stands = _boilerplate(parser, sizes, tags)
    bad = [e != NOWHERE and (stands[e] or parser.hidden[e]) for e in place]
    core = _content(sizes, tags, bad)
    total, votes, own = 0, defaultdict(int), [0] * len(parser.parent)
    for e, n, is_core in zip(place, sizes, core):
        if is_core:
            total += n
            if e != NOWHERE:
                own[e] += n
                if parser.region[e] != NOWHERE:
                    votes[parser.region[e]] += n
    if votes and sum(votes.values()) >= REGION * total:
        chosen = set(votes)
    else:
        # Without such a region: the innermost element that holds nearly all content.
        enough = [e for e, n in enumerate(_sums(parser.parent, own)) if n >= 0.9 * total and n]
        chosen = {enough[-1]} if enough else None
    inside = [False] * len(parser.parent)
    if chosen is not None:
        for e, above in enumerate(parser.parent):
            inside[e] = e in chosen or above != NOWHERE and inside[above]
    return "\n\n".join(
        text for text, e, b in zip(texts, place, bad) if not b and (chosen is None or e != NOWHERE and inside[e])
    )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) if p else "" for p in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(key, url, html).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


@query("op3_html_extraction")
def op3(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
