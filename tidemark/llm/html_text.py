"""Main text of web pages from the standard library's streaming HTML parser.

Parser events cut a page into lines, one per block element, each with its text and the tags met since the line
before. A line's text-to-tag ratio, smoothed by a Gaussian over neighbouring lines, tells dense runs of text from
lists of links; a two-cluster threshold on the smoothed ratios of the page marks the seeds. A content region is a
container (article, main, section, div, cell or body) that holds seeds, with all its lines that are not boilerplate:
short paragraphs, headings and linked lines between long ones stay, and nothing in a region is dropped or cut.
Lines inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments count
as ratio 0 and are never text, whatever their length. They are told by their element, or by class, id and role
names all of whose words are marks; wrappers of a page's text or of its articles are not boilerplate by their names.

Article and main elements are a prior among the containers of seeds: those with seeds are the regions, without the
ones inside them that hold no seed, unless the seeds outside have ``PRIOR`` times their text. The only article or
main element of a page is a region without seeds too, and the only one unless more than ``PRIOR`` seeds lie outside.

Defined results: null, empty and text-free pages give an empty text; broken mark-up is read as the parser reads it,
an element that is never closed ends with its page, and a closing tag without an opening one is passed over.
Character references are decoded. Rows are read one by one; ``url`` and ids may be null or repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body html".split())
MAIN = frozenset(("article", "main"))
UNSEEN = frozenset("script style noscript template head title iframe object svg math canvas select textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog search".split())
#: Words of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Of these, reader comments; neither they nor elements of ``ASIDE`` but forms ever wrap a page.
DISCUSSION = frozenset("comment comments disqus replies reply respond".split())
#: An element that a new block ends although its own end tag never came.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
SIGMA = 1.0
LINK_SHARE = 0.6
#: A mark on an element that holds more than this share of the page's text is that of a page's layout.
MOST = 0.5
#: Seeds outside of article and main elements need this many times the text of those inside, or this many lines.
PRIOR = 4

_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line:
    """A line with the numbers of the innermost container and the innermost marked element around it (0: none)."""

    __slots__ = ("text", "tags", "linked", "mark", "region")

    def __init__(self, text: str, tags: int, linked: int, mark: int, region: int):
        self.text, self.tags, self.linked = text, tags, linked
        self.mark, self.region = mark, region


class LineParser(HTMLParser):
    """Lines of a page as its events come; only the open elements and the current line are held besides them.

    Containers and marked elements are numbered as they open. Each keeps the number of the next container and the
    next marked element around it, so nesting of any depth costs a number an element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # element, innermost marked element, unseen, innermost container
        self.open: list[tuple[str, int, bool, int]] = []
        self.count: dict[str, int] = {}  # of open elements
        self.kinds: list[str] = ["html"]
        self.around: list[int] = [-1]  # the next container outside
        self.marked_around: list[int] = [0]  # the next marked element outside
        self.main: list[int] = [0]  # the outermost article or main element of each, itself included
        self.firm: set[int] = set()  # marked elements that are boilerplate wherever they are
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.links = 0

    def _state(self) -> tuple[int, bool, int]:
        """Innermost marked element, whether text is unseen, innermost container."""
        return self.open[-1][1:] if self.open else (0, False, 0)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text or self.tags:
            mark, _, region = self._state()
            self.lines.append(Line(text, self.tags, self.linked, mark, region))
        self.parts, self.tags, self.linked = [], 0, 0

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        """Is the element unseen, marked as boilerplate, and firmly so?"""
        unseen, marked, firm = tag in UNSEEN, False, False
        if tag in ("html", "body", "main"):
            return unseen, False, False
        # a heading's own header belongs to its article
        if tag in ASIDE and not (tag == "header" and any(self.count.get(x) for x in MAIN)):
            marked, firm = True, tag != "form"
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                unseen = True
            elif value and name in ("class", "id", "role") and tag not in ("p", "span", "a", "b", "i", "em", "strong"):
                for token in value.lower().split():
                    parts = set(_PARTS.split(token)) - {""}
                    # a token of several words is a mark if all of them are: cookie-notice, not has-banner
                    if parts and parts <= MARKS and (tag not in MAIN or parts <= DISCUSSION):
                        marked, firm = True, firm or not parts.isdisjoint(DISCUSSION)
            elif value and name == "style" and _HIDDEN.search(value.lower()):
                unseen = True
        return unseen, marked, firm

    def _close(self, depth: int) -> None:
        for tag, *_ in self.open[depth:]:
            self.links -= tag == "a"
            self.count[tag] -= 1
        del self.open[depth:]

    def _end_before(self, tag: str) -> None:
        """A new block ends an open paragraph, and an open item of its own kind."""
        ended = ENDED_BY.get(tag, ())
        if not any(self.count.get(x) for x in ("p", *ended)):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            kind = self.open[depth][0]
            if kind == "p" or kind in ended:
                self._close(depth)
            elif kind in BLOCKS:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self._end_before(tag)
        elif tag == "br" or tag == "img":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        mark, unseen, region = self._state()
        own_unseen, marked, firm = self._marked(tag, attrs)
        if tag in CONTAINERS or marked:
            number = len(self.kinds)
            self.kinds.append(tag)
            self.around.append(region)
            self.marked_around.append(mark)
            self.main.append(self.main[region] or (number if tag in MAIN else 0))
            if tag in CONTAINERS:
                region = number
            if marked:
                mark = number
            if firm:
                self.firm.add(number)
        self.links += tag == "a"
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, mark, unseen or own_unseen, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count.get(tag):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                if tag in BLOCKS or any(x[0] in BLOCKS for x in self.open[depth:]):
                    self.flush()
                self._close(depth)
                return
            # an inline end tag does not reach out of its block's container
            if self.open[depth][0] in CONTAINERS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self._state()[1]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbouring lines; beyond the page there are no lines."""
    if not len(ratios):
        return ratios
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel, mode="full")[reach:reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Midway between the centres of the two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = values > middle
        if upper.all() or not upper.any():
            return middle
        one, two = float(values[~upper].mean()), float(values[upper].mean())
        if (one, two) == (low, high):
            break
        low, high = one, two
    return (low + high) / 2


def _linked(line: Line) -> bool:
    return line.linked > LINK_SHARE * len(line.text)


def _boilerplate(parser: LineParser) -> list[bool]:
    """Which lines lie in marked elements.

    Marks that are not firm are passed over on an element that holds most of the page's text, unless an article or
    main element lies outside, and on elements around article and main elements that hold more text than all
    unmarked lines.
    """
    lines, firm, outside = parser.lines, parser.firm, parser.marked_around
    main = [parser.main[x.region] for x in lines]
    held = [0] * len(outside)
    for x in lines:
        held[x.mark] += len(x.text)
    for m in range(len(held) - 1, 0, -1):  # what is inside has the higher number
        if held[m]:
            held[outside[m]] += held[m]
    least = MOST * sum(len(x.text) for x in lines)
    named = any(x.text and k and not x.mark for x, k in zip(lines, main, strict=True))
    counts = [m > 0 and (named or m in firm or held[m] <= least) for m in range(len(outside))]
    # of each element: the innermost mark that counts, and whether one of those around it is firm
    innermost, hard = [0] * len(outside), [False] * len(outside)
    for m in range(1, len(outside)):
        innermost[m] = m if counts[m] else innermost[outside[m]]
        hard[m] = counts[m] and m in firm or hard[outside[m]]
    marked = [innermost[x.mark] > 0 for x in lines]
    inner = [(hard[x.mark] or innermost[x.mark] >= k) if k else own for x, k, own in zip(lines, main, marked, strict=True)]
    freed = sum(len(x.text) for x, k, own in zip(lines, main, inner, strict=True) if k and not own)
    if freed > sum(len(x.text) for x, k, own in zip(lines, main, marked, strict=True) if not k and not own):
        return inner
    return marked


def _holding(parser: LineParser, lines: list[Line]) -> set[int]:
    """The containers around some lines."""
    found = set()
    for x in lines:
        k = x.region
        while k >= 0 and k not in found:
            found.add(k)
            k = parser.around[k]
    return found


def _within(parser: LineParser, containers: set[int]) -> list[bool]:
    """Of every container, whether it is one of these or inside one."""
    found = [0 in containers]
    for k in range(1, len(parser.around)):
        found.append(k in containers or found[parser.around[k]])
    return found


def _chosen(parser: LineParser, text: list[Line], seeds: list[Line]) -> tuple[set[int], set[int]]:
    """The containers that are regions, and the article and main elements without seeds that are left out of them."""
    main = {k for k, kind in enumerate(parser.kinds) if kind in MAIN}
    named, held = main & _holding(parser, text), main & _holding(parser, seeds)
    outer = {parser.main[x.region] for x in text} - {0}
    others = [x for x in seeds if not parser.main[x.region]]
    if held:
        regions = outer & held
        if sum(len(x.text) for x in others) > PRIOR * sum(len(x.text) for x in seeds if parser.main[x.region]):
            regions |= {x.region for x in others}
        return regions, named - held
    if len(outer) == 1:
        return outer | ({x.region for x in others} if len(others) > PRIOR else set()), set()
    return {x.region for x in others}, named


def extract(html: str | None) -> str:
    """The main text, one line per block."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    usable = np.array([bool(x.text) and not out for x, out in zip(lines, _boilerplate(parser), strict=True)], dtype=bool)
    if not usable.any():
        return ""
    ratios = np.array([len(x.text) / max(1, x.tags) if ok and not _linked(x) else 0.0
                       for x, ok in zip(lines, usable.tolist(), strict=True)])
    smooth = smoothed(ratios)
    seeds = usable & (smooth >= threshold(smooth))
    if not seeds.any():  # the page's best line is an unusable one between two usable ones
        seeds[np.argmax(np.where(usable, smooth, -1.0))] = True
    text = [x for x, ok in zip(lines, usable.tolist(), strict=True) if ok]
    regions, empty = _chosen(parser, text, [x for x, ok in zip(lines, seeds.tolist(), strict=True) if ok])
    # where the whole page is the region, containers of nothing but links are not of the text
    running = _holding(parser, [x for x in text if not _linked(x)])
    within, without = _within(parser, regions), _within(parser, empty)
    narrow = _within(parser, {k for k in regions if parser.kinds[k] not in ("html", "body")})
    inside = [x for x in text if within[x.region] and not without[x.region]
              and not (_linked(x) and x.region not in running and not narrow[x.region])]
    return "\n".join(x.text for x in inside)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    made = pages.select("page_id", pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return made.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
