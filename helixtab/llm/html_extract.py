"""Main text of web pages: events of the standard library's streaming parser, text-to-tag ratio per line, Gaussian
smoothing and threshold clustering.

A line is one block of the page (a paragraph, heading, list item, table row ...) with the text and the number of tags that its
events bring. Its ratio is text length / tags. The smoothed ratios are split by a threshold in two clusters, and the lines of the upper one choose the content regions: an
article or main is content with all its lines if one of its lines is in the upper cluster or isn't all link (if none of any is: all of them); lines of the upper cluster outside are content too. On a page without those the
region runs from the first line of the upper cluster to the last, menus (short lines in a row that are all link) and copyright statements at its ends aside, and on to both sides over everything but such lines.

Marks correct this. Boilerplate elements (menus, headers, footers, side bars, notices, adverts, forms, reader comments) are told by tag, role, class or id and bring no lines; a mark counts
only as the head word of a class. No tag and no mark drops an element that holds an article or main, or most of the text of a page without those; but of articles, those inside such an element give way to
others. Scripts, styles and the like never bring lines. Content lines are returned, however short: nothing else is dropped or capped.

Null html is the empty text; a page without content gives the empty text; a null page_id is kept; repeated rows are pages of
their own; an empty table gives an empty result; extra columns are ignored. An unfinished tag at the end of a page cut short is
markup and dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Elements whose content is never main text, of these those that stand inside lines, and elements that are boilerplate unless they hold the page's text (fixed values of HTML).
SKIP = frozenset("script style head template iframe object svg canvas video audio select textarea".split())
INLINE = SKIP - frozenset(("head", "template"))
LIKELY = frozenset("nav header footer aside form noscript dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of a class, id or role that mark boilerplate.
MARK = re.compile(r"(?:^|[\s_-])(?:ads?|ad(?:slot|box|unit|banner)s?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|widget|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|share|social|stories|comments?|commentlist|comment(?:s|section|thread)|discussion|disqus|replies|respond|related|recommend\w*|pagination|pager|complementary|contentinfo|search|login|signup|toolbar|tags?)(?:$|[\s_-])", re.I)
#: Last words of a class that name its shape, and words that say that it is of something else.
SHAPE = frozenset("area bar block box buttons container inner items links list panel section wrap wrapper".split())
OTHER = frozenset("has no not with without".split())
CUT = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
#: Tags whose end may be left out, and those that end them.
IMPLIED = {"p": BLOCK, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
SIGMA = 1.0
#: Marks that count on an article too, and words of a menu's line at most.
COMMENT = re.compile(r"comments?|replies|reply|respond|discussion", re.I)
MENU_WORDS = 4
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


def marked(value: str, mark: re.Pattern = MARK) -> bool:
    """Whether the head word of one of the classes marks boilerplate; the whole class may be a mark too."""
    for token in value.lower().split():
        if not mark.search(token):
            continue
        words = [w for w in re.split(r"[_-]+", token) if w]
        while len(words) > 1 and words[-1] in SHAPE:
            words.pop()
        if mark.fullmatch(token) or words and not OTHER & set(words) and (mark.fullmatch(words[-1]) or mark.fullmatch("-".join(words[-2:]))):
            return True
    return False


class Line:
    """A block's text, its tags, the share of its characters in links, the outermost article or main around it (0: none), and whether that is inside an element that is kept for what it holds."""

    __slots__ = ("linked", "named", "tags", "text", "within")

    def __init__(self, text: str, tags: int, linked: int, named: int, within: bool):
        self.text, self.tags, self.linked, self.named, self.within = text, tags, linked / max(1, len(text)), named, within


class Lines(HTMLParser):
    """Collects lines. Every event takes constant time on average, however deep elements are nested."""

    def __init__(self, keep: set[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.inside: list[int] = []  # for each open element the number of the outermost article or main around it, itself included, or 0
        self.within: list[bool] = []  # for each open element whether one around it is kept for what it holds
        self.blocks: list[int] = []  # places of open block elements in the stack
        self.open: Counter[str] = Counter()
        self.skipped = 0  # open elements of SKIP
        self.skip = 0  # depth of the stack at which a skipped element began, and 0 outside
        self.keep = keep  # marked elements, by number of start tag, that are content all the same
        self.begun = 0
        self.marks: list[tuple[int, int, int]] = []  # open marked elements that are skipped: depth, number, text before
        self.passed = 0  # text length in skipped marked elements so far
        self.lost: dict[int, int] = {}  # that of each marked element
        self.holds: set[int] = set()  # marked elements with an article or main
        self.named = False  # the page has an article or main
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append(Line(text, self.tags, self.linked, self.inside[-1] if self.inside else 0, bool(self.within) and self.within[-1]))
                self.tags = 0
            self.text, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()
            self.inside.pop()
            self.within.pop()
            self.open[tag] -= 1
            self.skipped -= tag in SKIP
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
        while self.marks and self.marks[-1][0] > depth:
            _, number, before = self.marks.pop()
            self.lost[number] = self.passed - before
        if self.skip and len(self.stack) < self.skip:
            self.skip = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.begun += 1
        if tag in VOID:
            if not self.skip:
                self.tags += 1
                if tag == "hr":
                    self.flush()
                else:
                    self.text.append(" " if tag == "br" else "")
            return
        if self.blocks and not self.skip:
            k = self.blocks[-1]
            if self.stack[k] in IMPLIED and tag in IMPLIED[self.stack[k]]:
                self.flush()
                self.close_to(k)
        if not self.skip:
            self.tags += 1
            if tag not in INLINE and (tag in BLOCK or tag in SKIP or tag in LIKELY):
                self.flush()
        own = tag in ("article", "main")
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(tag)
        self.open[tag] += 1
        self.skipped += tag in SKIP
        around = self.inside[-1] if self.inside else 0
        self.inside.append(around or (self.begun if own else 0))
        self.within.append(self.begun in self.keep or (bool(self.within) and self.within[-1]))
        named = [v for k, v in attrs if v and k in ("class", "id", "role")]
        comment = own and any(marked(v, COMMENT) for v in named)
        if own and not comment:
            self.holds.update(number for _, number, _ in self.marks)
            self.named |= not self.skip
        if (self.skip and not self.marks) or tag in SKIP or (tag == "button" and not self.open["p"]) or any(k == "hidden" for k, _ in attrs):
            self.skip = self.skip or len(self.stack)
        elif self.begun not in self.keep and (comment or tag in LIKELY or (tag not in ("html", "body", "article", "main") and any(map(marked, named)))):
            self.skip = self.skip or len(self.stack)
            self.marks.append((len(self.stack), self.begun, self.passed))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        k = len(self.stack) - 1
        while self.stack[k] != tag:
            k -= 1
        if self.skip and k + 1 > self.skip:
            self.close_to(k)
            return
        if not self.skip:
            self.tags += 1
            if tag in BLOCK or tag in LIKELY:
                self.flush()
        self.close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(" ".join(data.split()))
        elif self.marks and not self.skipped:
            self.passed += len(" ".join(data.split()))


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines, weights renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-((d / sigma) ** 2) / 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= d < len(values):
                total += k * values[d]
                weight += k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of two clusters in one dimension (two means)."""
    low, high = min(values), max(values)
    for _ in range(30):
        cut = (low + high) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not a or not b:
            return low - 1
        nxt = sum(a) / len(a), sum(b) / len(b)
        if nxt == (low, high):
            break
        low, high = nxt
    return (low + high) / 2


def outer(lines: list[Line]) -> list[bool]:
    """Lines beside the region that don't belong to it: two and more short ones in a row that are all link, and copyright statements."""
    like = [x.linked >= 0.9 and len(x.text.split()) <= MENU_WORDS for x in lines]
    menu = [m and (k > 0 and like[k - 1] or k + 1 < len(like) and like[k + 1]) for k, m in enumerate(like)]
    return [m or (len(x.text) < 200 and bool(COPYRIGHT.match(x.text))) for x, m in zip(lines, menu, strict=True)]


def content(lines: list[Line], dense: list[bool]) -> list[bool]:
    """Which lines are content, given which are in the upper cluster."""
    own = {x.named for x in lines if x.named}
    if own:
        firm = {x.named for x in lines if x.named and not x.within} or own
        chosen = {x.named for x, d in zip(lines, dense, strict=True) if d or x.linked < 0.9} & firm or firm
        return [x.named in chosen if x.named else d and x.linked < 0.9 for x, d in zip(lines, dense, strict=True)]
    off = outer(lines)  # smoothing lifts the lines next to dense ones
    firm = [k for k, d in enumerate(dense) if d and not off[k]]
    return [bool(firm) and firm[0] <= k <= firm[-1] or not o for k, o in enumerate(off)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    keep: set[int] = set()
    for _ in range(2):
        parser = Lines(keep)
        parser.feed(CUT.sub("", html))
        parser.close()
        parser.flush()
        parser.close_to(0)
        if keep:
            break
        keep = parser.holds
        if not keep and not parser.named:
            total = sum(len(x.text) for x in parser.lines) + parser.passed
            keep = {k for k, n in parser.lost.items() if 2 * n > total}
        if not keep:
            break
    lines = parser.lines
    if not lines:
        return ""
    ratios = smooth([len(x.text) / max(1, x.tags) for x in lines])
    cut = threshold(ratios)
    return "\n".join(x.text for x, c in zip(lines, content(lines, [r > cut for r in ratios]), strict=True) if c)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    rows = only(pages, page_id="bigint", url="string", html="string")
    return rows.mapInArrow(_batches, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
