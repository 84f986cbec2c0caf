"""Main text of HTML pages from parser events and text-to-tag ratios.

The standard library's streaming parser gives events; text is gathered in blocks, the
"lines" of the page, and every block has the ratio of its characters to the tags met in it.
The ratios are smoothed by a Gaussian window and clustered by a threshold on their spread;
blocks above it are content.  The content region is the article or main element that holds
most of the content, with those beside it that hold at least half as much, or else the lowest
container of all of it.  All blocks of that region are
kept, short ones too, except those in elements that are never content: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.  A class or
id, or being a form, bars an element only if it holds neither a main landmark nor the bulk of
the page's text, as wrappers may be named after what they hold or leave out.

Character references are decoded, white space in a block (a line break counts as such)
becomes one space, blocks are trimmed and joined by newlines in page order.

Defined results: a null or empty page gives the empty text; text outside all elements is a
block of the page; unclosed elements end with their parent; repeated rows give one row each;
an empty table gives no row; other columns are ignored.  Pages are parsed whole.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Names that HTML and common practice give to parts of a page.
NEVER_CONTENT = frozenset(
    "nav header footer aside script style noscript template svg math button select option "
    "textarea iframe object menu dialog head title canvas audio video map".split()
)
NEVER_CONTENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
)
NEVER_CONTENT_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner promo promotion sponsor "
    "sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager header "
    "masthead footer comment comments commentlist disqus replies share sharing social related "
    "recommended widget toolbar".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new element of the key ends an open one of the values, as HTML lets authors omit the end.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
LISTS = {"ul", "ol", "dl", "table", "menu"}
LANDMARKS = ("article", "main")
#: Share of the page's text that an element named, or partly named, like a part of a page must hold to be its content.
BULK, HALF = 0.8, 0.5
SIGMA = 1.0
#: Elements that a page is built of; any other is a part of the text, and so is the one around a lone block.
CONTAINERS = frozenset("html body div section center td".split())


class PageReader(HTMLParser):
    """Blocks of a page: (text, tags, innermost open element).

    Elements are numbered as they open and kept with their parent and the last element opened
    inside them, so that all work on a page is linear in its length, however deep it nests.
    Names bar an element only by ``barred_by_name``, when the whole page is known.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int]] = []
        # by element, the page itself first: tag, parent, last element inside, never content
        self.elements: list[str] = [""]
        self.parent: list[int] = [0]
        self.last: list[int] = [0]
        self.never: list[bool] = [False]
        self.open: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # by tag, where it is among the open elements
        self.landmarks: set[int] = set()
        #: Elements with a name of parts that are no content: share of the text that says otherwise.
        self.named: dict[int, float] = {}
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and not self.never[self.open[-1]]:
            self.blocks.append((text, self.tags, self.open[-1]))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._close("p", stop=LISTS)
        for ended in ENDS.get(tag, ()):
            self._close(ended, stop=LISTS - {tag})
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        names = f"{given.get('class', '')} {given.get('id', '')}".lower()
        never = tag in NEVER_CONTENT or given.get("role", "").lower() in NEVER_CONTENT_ROLES
        number = len(self.elements)
        if tag not in ("html", "body", *LANDMARKS):
            if not NEVER_CONTENT_NAMES.isdisjoint(names.split()):
                self.named[number] = BULK
            elif tag == "form" or not NEVER_CONTENT_NAMES.isdisjoint(re.split(r"[\s_-]+", names)):
                self.named[number] = HALF
        if tag in LANDMARKS or given.get("role", "").lower() in LANDMARKS:
            self.landmarks.add(number)
        above = self.open[-1]
        self.elements.append(tag)
        self.parent.append(above)
        self.last.append(number)
        self.never.append(never or self.never[above])
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self._close(tag)

    def _close(self, tag, stop=frozenset()):
        """Close the innermost open element of a tag and all inside it, unless a ``stop`` is between."""
        at = self.places.get(tag)
        if at and all(self.places[s][-1] <= at[-1] for s in stop if self.places.get(s)):
            self._close_from(at[-1])

    def _close_from(self, place: int) -> None:
        while len(self.open) > place:
            number = self.open.pop()
            self.last[number] = len(self.elements) - 1
            self.places[self.elements[number]].pop()

    def finish(self) -> None:
        self.close()
        self.flush()
        self._close_from(1)
        self.last[0] = len(self.elements) - 1

    def masses(self, blocks: list, counted) -> list[int]:
        """By element, the characters inside it of the blocks that count."""
        mass = [0] * len(self.elements)
        for (text, _, inner), counts in zip(blocks, counted):
            mass[inner] += len(text) * bool(counts)
        for e in range(len(mass) - 1, 0, -1):
            mass[self.parent[e]] += mass[e]
        return mass

    def holds(self, element: int, inner: int) -> bool:
        return element <= inner <= self.last[element]

    def handle_data(self, data):
        self.text.append(data)

    def parse_marked_section(self, i, report=1):
        """``<![`` of any kind is a bogus comment up to the next ``>``, the end of the page at last."""
        end = self.rawdata.find(">", i + 3)
        return len(self.rawdata) if end < 0 else end + 1


def barred_by_name(reader: PageReader, blocks: list) -> set[int]:
    """Named elements that hold neither the bulk of the page's text nor its landmark."""
    if not reader.named:
        return set()
    n, parent = len(reader.elements), reader.parent
    mass = reader.masses(blocks, [True] * len(blocks))
    # comments may be articles too: a landmark counts if it is half as long as the longest ...
    largest = max((mass[e] for e in reader.landmarks), default=0)
    inside = [0] * n  # the longest such landmark inside an element
    for e in range(n - 1, 0, -1):
        own = mass[e] if e in reader.landmarks and mass[e] >= HALF * largest else 0
        inside[parent[e]] = max(inside[parent[e]], inside[e], own)
    # ... and half as long as what stands elsewhere under no such name but those around the element
    nearest = [0] * n  # the innermost named element that holds an element, or is it
    for e in range(1, n):
        nearest[e] = e if e in reader.named else nearest[parent[e]]
    under = [0] * n
    for text, _, inner in blocks:
        under[nearest[inner]] += len(text)
    elsewhere = {0: 0}
    for e in sorted(reader.named):
        above = nearest[parent[e]]
        elsewhere[e] = elsewhere[above] + under[above]
    return {e for e, share in reader.named.items()
            if mass[e] < share * mass[0] and not (inside[e] and inside[e] >= HALF * elsewhere[e])}


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios under a normalised Gaussian window."""
    reach = max(1, int(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    norm = np.convolve(np.ones(len(ratios)), window)[reach:-reach]
    return np.convolve(ratios, window)[reach:-reach] / norm


def main_text(html: str | None) -> str:
    """The main text of one page."""
    reader = PageReader()
    reader.feed(html or "")
    reader.finish()
    barred = barred_by_name(reader, reader.blocks)
    out = [e in barred for e in range(len(reader.elements))]
    for e in range(1, len(out)):
        out[e] |= out[reader.parent[e]]
    blocks = [b for b in reader.blocks if not out[b[2]]]
    if not blocks:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in blocks])
    smooth = smoothed(ratios)
    content = smooth >= min(smooth.std(), smooth.max())
    mass = reader.masses(blocks, content)
    filled = reader.masses(blocks, [True] * len(blocks))
    marked = [e for e in reader.landmarks if filled[e]]
    if marked:
        # the largest, of nested ones with the same content the inner one, and those beside it that
        # hold at least half as much content
        largest = max(marked, key=lambda e: (mass[e], e))
        regions = [e for e in marked if e == largest or reader.parent[e] == reader.parent[largest]
                   and mass[e] >= HALF * mass[largest] > 0]
    else:
        # the lowest element that holds every content block
        inner = [b[2] for b, is_content in zip(blocks, content) if is_content]
        region, low, high = inner[0], min(inner), max(inner)
        while region and (not reader.holds(region, low) or not reader.holds(region, high)
                          or reader.elements[region] not in CONTAINERS or len(inner) == 1 and region == inner[0]):
            region = reader.parent[region]
        regions = [region]
    regions.sort()
    starts = np.array(regions)
    at = np.searchsorted(starts, [b[2] for b in blocks], side="right") - 1
    return "\n".join(text for (text, _, inner), k in zip(blocks, at.tolist())
                     if k >= 0 and reader.holds(regions[k], inner))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length for every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "text": texts,
                "n_chars": [len(t) for t in texts],
            })

    return pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id bigint, url string, text string, n_chars bigint"
    )
