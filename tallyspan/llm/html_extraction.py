"""HTML extraction: parser events to blocks, text-to-tag ratios, Gaussian smoothing, threshold, content region.

1. One pass of the standard library's streaming parser turns a page into blocks (the lines of the method), each with its
   text, the tags met since the block before and the element it ends in.
2. Ratios of text to tags are smoothed along the page by a Gaussian, so that a short line takes part in what stands
   around it. The threshold that parts the logarithms of the levels best (largest variance between both sides) makes two
   clusters, if their means are ``APART`` apart; else all blocks are one.
3. The lowest element that holds nine tenths of the upper clusters' text is the content region. Its blocks count, short
   ones too; where it is the whole page, those from the first to the last clustered one. Outside it count clustered
   blocks that are not mostly links, and headings right before what counts. Where articles or mains hold half of the
   clusters' text, those with a block above the page's mean level and those beside them are the region.

Names of elements and whole class, id or role values only take out furniture. A mark takes out no element that holds
an outermost article or half of the clusters' text. A header inside an article is the article's own.

Defined results: null, empty and text-less pages give the empty string; unclosed and misnested markup is read as
the parser reads it, a marked section (``<![...``) as a comment up to the next ``>``,
what follows the last ``>`` as text; if the parser refuses markup all
the same, the page ends there; repeated rows are extracted alike; pages of any length are read whole, in time and
memory that grow with their length, whatever the nesting; an empty table gives an empty result; extra columns are not
carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm.shared import table

# Element names of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title svg math iframe object canvas audio video select option textarea button".split())
FURNITURE = set("nav header footer aside menu dialog".split())
#: Furniture like a marked element: not where it holds the content, as a form around the whole page does.
FORMS = set("form fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
REGIONS = set("article main".split())
#: Least distance of the clusters' mean levels, in natural logarithms.
APART = 2.0
#: Words that mark page furniture. A class, id or role value counts as a whole: each part of it between '-' and '_' is one of
#: these words, one of ALONG or a number, so that "no-sidebar", "layout-sidebar-right" and "related-work" are no marks.
OTHERS = r"comments?|commentlist|replies|respond|disqus|related|recommend\w*|promo\w*"
MARKS = re.compile(
    rf"{OTHERS}|ads?|advert\w*|adsense|sponsor\w*|banners?|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|"
    r"sidebars?|widgets?|footer|header|masthead|toolbar|share|social|complementary|contentinfo|search|pagination|pager|login|signup|skip",
    re.IGNORECASE,
)
#: Marks of texts beside the page's own; an article or main may have the last two as well.
BESIDE = re.compile(OTHERS, re.IGNORECASE)
BESIDE_REGION = re.compile(OTHERS + "|reply|teasers?", re.IGNORECASE)
ALONG = re.compile(
    r"\d+(?:x\d+)?|top|bottom|left|right|upper|lower|main|global|site|page|primary|secondary|mobile|desktop|sticky|fixed|inner|outer|box|bar|block|list|items?|wrap|wrapper|container|area|section|"
    r"region|row|col|column|panel|card|body|div|group|slot|unit|space|overlay|title|text|message|links?|buttons?|btn|icons?|form|thread|posts?|articles?|stories|pages",
    re.IGNORECASE,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: An open <p> ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}


@dataclass(eq=False, slots=True)
class Element:
    name: str
    parent: Element | None
    out: bool  # furniture or silent, by itself or by an element around it
    region: Element | None = None  # the outermost article or main around it, or itself
    mark: Element | None = None  # the nearest marked element around it, or itself
    says_beside: bool = False  # whether its own mark is one of texts beside the page's own
    beside: bool = False  # whether it is or lies in such an element
    link: bool = False  # whether it is or lies in a link
    heading: bool = False
    holder: bool = False  # of a marked element: whether an outermost article or main lies in it
    weight: int = 0  # text of clusters in it
    inside: bool = False  # whether it is or lies in the content region


def marks(value: str, words: re.Pattern[str] = MARKS) -> bool:
    """Whether one of the value's tokens as a whole marks furniture."""
    for token in value.split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        found = [bool(words.fullmatch(p)) for p in parts]
        along = (f or ALONG.fullmatch(p) or (k and p.lower() == "content") for k, (p, f) in enumerate(zip(parts, found, strict=True)))
        if any(found) and (parts[0].lower() == "skip" or all(along)):
            return True
    return False


@dataclass(eq=False, slots=True)
class Block:
    text: str
    tags: int
    at: Element
    links: bool = False  # mostly links, and no heading
    out: bool = False


class Blocks(HTMLParser):
    """Collects the blocks and elements of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Block] = []
        self.every = [Element("", None, False)]  # elements around others come before them
        self.open = [self.every[0]]
        self.places: dict[str, list[int]] = {}  # where in ``open`` elements of a name are
        self.barriers = [0]  # where in ``open`` elements are that others are not closed past
        self.tags, self.parts, self.linked = 0, [], 0
        self.unclosed = False  # whether a comment without an end was met: none further on has one

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        linked, self.parts, self.linked = self.linked, [], 0
        if text:
            top = self.open[-1]
            self.found.append(Block(text, self.tags, top, linked * 2 > len(text) and not top.heading, top.out))
            self.tags = 0

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if name == "br":
            self.parts.append(" ")
        if name in ENDS_PARAGRAPH or name in REGIONS:
            self.close_to("p", within=True)
        if name in BLOCKS:
            self.end_block()
        if name in VOID:
            return
        if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            self.close_to(name, within=True)
        top = self.open[-1]
        given = dict(attrs)
        furniture = name in FURNITURE and not (name == "header" and top.region)
        out = top.out or name in SILENT or furniture or "hidden" in given or given.get("aria-hidden") == "true" or bool(HIDDEN.search(given.get("style") or ""))
        new = Element(name, top, out, top.region, top.mark, False, top.beside, top.link or (name == "a" and "href" in given), top.heading or name in HEADINGS)
        if not out and name not in ("html", "body"):
            beside = self.mark(name, given, top.region is not None)
            if beside is not None:
                new.mark, new.says_beside, new.beside = new, beside, new.beside or beside
            if name in REGIONS and not top.region:  # an article inside an article's content belongs to the outer one
                new.region = new
                if new.mark and not new.beside:
                    new.mark.holder = True
        if out != top.out or new.mark is not top.mark:
            self.end_block()
        if name in BLOCKS:
            self.barriers.append(len(self.open))
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(new)
        self.every.append(new)

    def mark(self, name: str, given: dict[str, str | None], in_region: bool) -> bool | None:
        """None for no mark, else whether it is one of texts beside the page's own."""
        said = " ".join(given.get(k) or "" for k in ("class", "role"))
        own = given.get("id") or ""
        if name in REGIONS:
            return True if marks(f"{said} {own}", BESIDE_REGION) else None
        if name in HEADINGS or name == "section":  # their ids are anchors of the text; outside articles a section of comments has one too
            own = own if name == "section" and not in_region and marks(own, BESIDE) else ""
        said = f"{said} {own}"
        return marks(said, BESIDE) if name in FORMS or marks(said) else None

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID and name not in ("script", "style"):
            self.handle_endtag(name)

    def close_to(self, name: str, within: bool = False) -> None:
        """Closes the innermost open element of the name; with ``within`` not past another kind of container."""
        places = self.places.get(name)
        if not places or (within and places[-1] < self.barriers[-1]):
            return
        k = places[-1]
        here, below = self.open[k], self.open[k - 1]
        if name in BLOCKS or here.out != below.out or here.mark is not below.mark:
            self.end_block()
        for gone in self.open[k:]:
            self.places[gone.name].pop()
        del self.open[k:]
        while self.barriers[-1] >= k:
            self.barriers.pop()

    def handle_endtag(self, name: str) -> None:
        self.tags += 1
        if name == "br":
            self.parts.append(" ")
        elif name not in VOID:
            self.close_to(name)

    def handle_data(self, data: str) -> None:
        if self.open[-1].name not in ("script", "style"):
            self.parts.append(data)
            if self.open[-1].link:
                self.linked += len(" ".join(data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A comment up to the next ``>``, whatever it says; the parser's own version refuses unknown words."""
        return self.rawdata.find(">", i) + 1 or -1

    def parse_comment(self, i: int, report: int = 1) -> int:
        at = -1 if self.unclosed else super().parse_comment(i, report)
        self.unclosed |= at < 0
        return at


def smoothed(ratio: np.ndarray, radius: int = 2) -> np.ndarray:
    """Convolution with a Gaussian of standard deviation ``radius / 2``; the ends are repeated."""
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-(offsets**2) / (2 * (radius / 2) ** 2))
    return np.convolve(np.pad(ratio, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(levels: np.ndarray) -> float:
    """The least level of the upper of two clusters, or of all if they are not ``APART``."""
    order = np.sort(levels)
    n = len(order)
    sums = np.cumsum(order)
    below = np.arange(1, n)
    low, high = sums[:-1] / below, (sums[-1] - sums[:-1]) / (n - below)
    between = below * (n - below) * (high - low) ** 2
    between[order[1:] == order[:-1]] = -1  # equal levels stay together
    if n < 2 or between.max() <= 0:
        return float(order[0])
    k = int(between.argmax())
    return float(order[k + 1] if high[k] - low[k] >= APART else order[0])


def clusters(blocks: list[Block]) -> tuple[list[Block], list[Block]]:
    """The usable blocks whose smoothed ratio of text to tags is in the upper cluster, and those above the page's mean."""
    ratio = np.asarray([len(b.text) / max(1, b.tags) if not b.out else 0.0 for b in blocks])
    usable = np.asarray([not b.out for b in blocks])
    levels = smoothed(ratio)
    least, mean = np.expm1(threshold(np.log1p(levels[usable]))) * (1 - 1e-9), levels.mean()
    upper = [(b, level) for b, level in zip(blocks, levels, strict=True) if not b.out and level >= least]
    return [b for b, _ in upper], [b for b, level in upper if level >= mean]


def take_out_marked(page: Blocks) -> None:
    """Marks the blocks of furniture by class, id or role as out.

    A marked element that holds an outermost article or main, or half of the clusters' text of the article or page that it
    lies in, is no furniture. Texts beside the page's own, such as comments, may be longer than it: they go where an
    article or main has a block outside them at least half as long as theirs are on average.
    """
    marked = [e for e in page.every if e.mark is e]
    usable = [b for b in page.found if not b.out]
    if not marked or not usable:
        return
    around: dict[Element | None, int] = {}  # text by article, None for the whole page
    for b in clusters(page.found)[0]:
        for r in {None, b.at.region}:
            around[r] = around.get(r, 0) + len(b.text)
        if b.at.mark:
            b.at.mark.weight += len(b.text)
    for e in reversed(marked):
        if e.parent.mark:
            e.parent.mark.weight += e.weight
            e.parent.mark.holder |= e.holder
    others = [len(b.text) for b in usable if b.at.beside]
    own = max((len(b.text) for b in usable if b.at.region and not b.at.beside), default=0) * len(others) * 2 >= sum(others)
    out: set[Element] = set()
    for e in marked:
        minor = not e.holder and e.weight * 2 < max(1, around.get(e.parent.region, 0))
        if e.parent.mark in out or (e.says_beside and own) or minor:
            out.add(e)
    gone = [b for b in usable if b.at.mark in out]
    if len(gone) < len(usable):
        for b in gone:
            b.out = True
    for e in marked:
        e.weight = 0


def content(page: Blocks) -> list[Block]:
    """The blocks of the region that the content clusters lie in."""
    usable = [b for b in page.found if not b.out]
    if not usable:
        return []
    chosen, heavy = clusters(page.found)
    total = sum(len(b.text) for b in chosen)
    # every article with a heavy block, and those beside it, are parts of one content
    held = [b for b in chosen if b.at.region]
    around = {b.at.region.parent for b in heavy if b.at.region}
    if around and sum(len(b.text) for b in held) * 2 >= total:
        return [b for b in usable if b.at.region and b.at.region.parent in around]
    for b in chosen:  # the element that a block ends in is the block's own
        (b.at.parent or b.at).weight += len(b.text)
    for e in reversed(page.every[1:]):
        e.parent.weight += e.weight
    region = page.every[0]
    for e in page.every:  # elements that hold so much lie in one another
        if e.weight * 10 >= total * 9:
            region = e
    for e in page.every:
        e.inside = e is region or (e.parent is not None and e.parent.inside)
    counted = set(chosen)
    if region.name in ("", "html", "body"):
        ends = [k for k, b in enumerate(usable) if b in counted]
        inner = {b for b in usable[ends[0] : ends[-1] + 1] if b.at.inside}
    else:
        inner = {b for b in usable if b.at.inside}
    taken, after = [], False
    for b in reversed(usable):
        takes = b in inner or (not b.links and (b in counted or (b.at.heading and after)))
        if takes:
            taken.append(b)
        after = takes or (after and b.links)
    return taken[::-1]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Blocks()
    last = html.rfind(">") + 1  # no tag ends behind it, and the parser would look for an end again and again
    try:
        page.feed(html[:last])
        page.close()
        page.handle_data(unescape(html[last:]))
    except AssertionError:  # how the parser refuses markup that it cannot make anything of
        pass
    page.end_block()
    take_out_marked(page)
    return "\n\n".join(b.text for b in content(page))


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(extractor, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
