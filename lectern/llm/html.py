"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, and a threshold that finds the region."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
#: Elements whose text is never part of an article.
DROPPED = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "footer", "form": "form", "dialog": "notice",
           **dict.fromkeys("head script style noscript template iframe object svg annotation annotation-xml button select textarea canvas "
                           "audio video".split(), "markup")}
#: Elements of formulas; their text belongs to the line and their tags don't count.
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle msub msup msubsup munder mover "
                 "munderover mmultiscripts mprescripts mpadded mphantom merror menclose mfenced mtable mtr mtd maction".split())
#: Words of which a class, id or role has to consist to mark such parts, with the reason; they weigh, they don't drop.
MARKED = {
    **dict.fromkeys("nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc toolbar".split(), "menu"),
    **dict.fromkeys("sidebar aside rail widget widgets complementary related recommended recommendations".split(), "side"),
    **dict.fromkeys("footer contentinfo colophon".split(), "footer"),
    **dict.fromkeys("masthead topbar".split(), "header"),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner".split(), "advert"),
    **dict.fromkeys("cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe "
                    "subscription paywall".split(), "notice"),
    **dict.fromkeys("comment comments respond disqus replies discussion".split(), "comment"),
    **dict.fromkeys("form login signin search share sharing social".split(), "form"),
    "hidden": "markup",
}
#: Marked words of parts that are no article whatever they hold: reader comments, notices, sidebars, adverts.
STRICT = frozenset("comment comments disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter "
                   "subscribe subscription paywall sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
#: Share of a page's content beyond which such a part is the article after all, under a misleading name.
MISNAMED = 0.8
#: Words that such names may hold besides, as in 'sidebar-left'.
NEUTRAL = frozenset("left right top bottom box wrapper container block bar list item site".split())
#: Weight of the smoothed ratio of lines in marked parts; so many times the other content makes them stretch the region.
DISCOUNT, OUTWEIGHS = 0.6, 5
#: Elements of single lines, which are no region by themselves.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd caption figcaption summary legend option".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: An article that begins inside one of these means that their end tag is missing.
_LEAKS = frozenset(["menu", "header", "advert", "notice", "footer", "side"])


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0
    path: tuple[int, ...] = ()


class Lines(HTMLParser):
    """Turns parser events into lines outside of dropped parts, each with the containers around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.line = Line()
        self.stack: list[tuple[str, str | None, int]] = []  # tag, why its text is dropped, number of the element
        self.names: list[str] = []  # tag of each container by number
        self.marks: dict[int, str] = {}  # reason of each container whose names mark it
        self.strict: set[int] = set()  # those marked by strict words
        self.links = 0

    @property
    def why(self) -> str | None:
        return self.stack[-1][1] if self.stack else None

    def _end_line(self) -> None:
        if self.line.text:
            self.line.path = tuple(n for _, _, n in self.stack)
            self.lines.append(self.line)
        self.line = Line()

    @property
    def _inside(self) -> bool:
        return any(t in ("article", "main") for t, _, _ in self.stack)

    def _reason(self, tag: str, attrs: list) -> str | None:
        if tag in DROPPED:
            return DROPPED[tag]
        if tag == "header":
            return "heading" if self._inside else "header"
        for name, value in attrs:
            value = value or ""
            if name == "hidden":
                return "markup"
            if tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
                continue
            if name == "aria-hidden" and value == "true":
                return "markup"
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "markup"
        return None

    def _mark(self, tag: str, attrs: list) -> tuple[str, bool] | None:
        """Why the names of an element speak against its text: one of them consists of marked words. And if strictly."""
        if tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            return None
        found = None
        for name, value in attrs:
            for token in (value or "").split() if name in ("class", "id", "role") else ():
                words = [w.lower() for w in _WORDS.findall(token)]
                why = next((MARKED[w] for w in words if w in MARKED), None)
                if not why and "header" in words and not self._inside:
                    why = "header"
                if why and all(w in MARKED or w in NEUTRAL or w == "header" for w in words):
                    strict = any(w in STRICT for w in words)
                    if strict or not found:
                        found = why, strict
                    if strict:
                        return found
        return found

    def barred(self, path: tuple[int, ...]) -> int | None:
        """The outermost strictly marked element of a line, if :meth:`marked` finds any mark that holds."""
        return next((n for n in path if n in self.strict), None) if self.marked(path) is not None else None

    def marked(self, path: tuple[int, ...]) -> int | None:
        """The innermost marked element of a line. An article inside one means that its end tag is missing."""
        article = False
        for n in reversed(path):
            if n in self.marks:
                return None if article and self.marks[n] in _LEAKS else n
            article = article or self.names[n] in ("article", "main")
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._end_line()
            return
        if tag in VOID:
            return
        why = self._reason(tag, attrs) if tag in BLOCKS or tag in DROPPED or attrs else None
        if tag not in BLOCKS and tag not in DROPPED and not why:
            self.line.tags += tag not in MATH
            self.links += tag == "a"
            return
        if tag in BLOCKS:
            self._end_line()
            if self.stack and self.stack[-1][0] == tag and tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
                self.stack.pop()
            elif self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            if tag in ("article", "main") and self.why in _LEAKS and not why:
                while self.stack and self.stack[-1][1]:
                    self.stack.pop()
            self.links = 0
        outer = self.why
        if outer == "heading" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not why:
            outer = None
        if tag in BLOCKS and not why and (mark := self._mark(tag, attrs)):
            self.marks[len(self.names)] = mark[0]
            if mark[1]:
                self.strict.add(len(self.names))
        self.names.append(tag)
        self.stack.append((tag, outer or why, len(self.names) - 1))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self._end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
            self.links = 0
        elif tag == "a":
            self.links = max(0, self.links - 1)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                break

    def handle_data(self, data: str) -> None:
        if self.why is None:
            self.line.text.append(data)
            if self.links:
                self.line.linked += len(data.strip())


def _parsed(page: str) -> Lines:
    parser = Lines()
    try:
        parser.feed(page)
        parser.close()
    except AssertionError:  # declarations that the parser refuses are text
        parser = Lines()
        parser.feed(page.replace("<!", "&lt;!"))
        parser.close()
    parser._end_line()
    return parser


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; ends weigh what there is."""
    reach = int(3 * sigma)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2))
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def two_clusters(values: np.ndarray) -> np.ndarray:
    """Which values belong to the upper of two clusters (threshold midway between their means, iterated).

    Means less than a factor of two apart are one cluster: lines of one kind are not split by chance.
    """
    at = values.mean()
    for _ in range(50):
        low, high = values[values < at], values[values >= at]
        new = (low.mean() + high.mean()) / 2 if len(low) else at
        if abs(new - at) < 1e-9:
            break
        at = new
    upper = values >= at
    return upper if upper.all() or values[~upper].mean() < 0.5 * values[upper].mean() else np.ones(len(values), bool)


def _region(found: list[tuple[str, Line]], names: list[str], content: np.ndarray, plain: np.ndarray) -> set[int]:
    """Numbers of the containers whose lines are the region: the smallest one that holds all content; the page is -1.

    Inside an article that is the whole innermost article, and its sibling articles of running text count too.
    """
    paths = [(-1, *x.path) for _, x in found]
    around = None
    for path, c in zip(paths, content):
        if c:
            same = path if around is None else around
            around = tuple(a for a, _ in takewhile(lambda x: x[0] == x[1], zip(same, path)))
    around = around or (-1,)
    while len(around) > 1 and names[around[-1]] in LEAVES:
        around = around[:-1]
    best = max((n for n in around if n >= 0 and names[n] == "article"), default=around[-1])
    chosen, sizes = {best}, {}
    for path, p, (text, _) in zip(paths, plain, found):
        for outer, n in zip(path, path[1:]):
            if names[n] == "article":
                at = sizes.setdefault(n, [outer, 0, 0])
                at[1], at[2] = at[1] + p, at[2] + len(text)
    beside = {outer for n, (outer, _, _) in sizes.items() if n == best}
    return chosen | {n for n, (outer, p, s) in sizes.items() if outer in beside and p > 0.5 * s}


def main_text(page: str) -> str:
    """The article of one page: lines joined by line ends, white space inside a line as one space.

    Menus, headers, footers, sidebars, forms and scripts are left out by their elements. Of the rest, the lines whose
    smoothed text-to-tag ratio lies in the upper cluster show where the content is,
    on every page and inside or outside of article elements; its region is the smallest container (in an article, the
    innermost whole article) that holds all of these lines. All lines of the region are kept, short ones and link lines
    too, and so is a title (h1) before it with what follows. Reader comments, notices, sidebars and adverts by their names
    (``STRICT``) are left out wherever they stand, unless one holds more than ``MISNAMED`` of the content, or nothing else
    holds any. Where only the page itself holds them, link lines before
    the first and behind the last content line are left out. Names of elements (``MARKED``) discount the ratio of their
    lines, and marked parts stretch the region only when their content outweighs all other by far; inside it a marked
    part without any content line is left out.
    """
    parser = _parsed(page)
    found = []
    for line in parser.lines:
        text = _SPACE.sub(" ", "".join(line.text)).strip()
        if text:
            found.append((text, line))
    if not found:
        return ""
    size = np.array([len(t) for t, _ in found], float)
    linked = np.array([min(x.linked, len(t)) for t, x in found], float)
    ratio = (size - linked) / np.array([x.tags for _, x in found])
    marks = [parser.marked(x.path) for _, x in found]
    discount = np.array([1 if m is None else DISCOUNT for m in marks])
    content = two_clusters(smoothed(ratio) * discount) & (linked < 0.5 * size)
    barred = [parser.barred(x.path) for _, x in found]
    held = defaultdict(float)
    for n, s, c in zip(barred, size, content):
        held[n] += s * c
    out = np.array([n is not None and held[n] <= MISNAMED * size[content].sum() for n in barred])
    out &= bool((content & ~out).any())
    content &= ~out
    bare = content & (discount == 1)
    if size[content & ~bare].sum() > OUTWEIGHS * size[bare].sum():
        bare = content
    chosen = _region(found, parser.names, bare, size - linked)
    whole = {m for m, c in zip(marks, content) if c}
    plain = np.array([m is None or m in whole for m in marks]) & ~out
    kept = np.array([not chosen.isdisjoint((-1, *x.path)) for _, x in found]) & plain
    if bare.any() and all(n < 0 or parser.names[n] in ("html", "body") for n in chosen):
        at = np.flatnonzero(bare)
        outside = np.ones(len(found), bool)
        outside[at[0]:at[-1] + 1] = False
        kept &= ~outside | (linked < 0.8 * size)
    titles = [any(parser.names[n] == "h1" for n in x.path) for _, x in found]
    if kept.any() and not any(t and k for t, k in zip(titles, kept)):
        first = int(kept.argmax())
        start = max((i for i in range(first) if titles[i]), default=first)
        kept[start:first] = plain[start:first] & (linked[start:first] < 0.5 * size[start:first])
    return "\n".join(t for (t, _), k in zip(found, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every page; null or empty html gives an empty text.

    Pages are parsed one by one in their input partitions, nothing is shuffled; repeated rows are parsed each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in texts_of(batch.column(2))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pc.utf8_length(text).cast(pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
