"""Main text of web pages from the events of the standard library's HTML parser.

The parser streams a page into lines, one for each block of text, with the characters
of its text, those of them in links, the tags since the line before, and the element
it lies in. Lines in elements that are never content (``APART``) are apart; so are those
in elements whose class, id or role names such a part (``MARKS``), unless the element turns
out to be a wrapper of the page: that is weighed by the text it holds (``_wraps``).

A line's ratio is its characters outside links over its tags; lines that are apart have
ratio 0. The ratios are smoothed with a Gaussian kernel; lines at or above the threshold
(the standard deviation of the smoothed ratios, but no more than half their greatest)
cluster into content regions. Where article or main elements hold most of these regions,
all of them are the content; else it is the least element that holds almost all of the
regions' characters. Its blocks are kept whole, so a short line amid the article isn't
lost. In an element that isn't an article, what lies before the first or after the last
content line is kept if it is the element's own, a heading that is no link, or in a child
with a content line; other children there go if they are mostly links, and, where only
the page as a whole holds the content, if they are no lists, tables or quotations.

Pages are independent: nothing is shuffled. Null and empty html give an empty text. Html
that is cut off or never closes its elements is read as far as it goes, in time that is in
proportion to its length however deep it nests. Equal rows get equal results. Null ids and
urls stay null. Empty tables give empty results. Other columns are not read. A page needs
memory in proportion to its html.
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

from quillmatch.llm.shared import slices, table, tidy

#: Elements whose text is never shown or never part of an article.
HIDDEN = frozenset("script style head title noscript template iframe object svg canvas select textarea button audio video datalist math".split())
APART = frozenset("nav footer aside form menu dialog header".split())
#: Words in a name (class, id or role) of what is not the article, and of readers' comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "adsbygoogle footer header masthead cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended "
    "pagination pager widget widgets toolbar skip complementary contentinfo search".split()
)
COMMENTS = frozenset("comment comments reply replies disqus discussion".split())
#: Before a mark, these say that the element only knows of such a part.
WITHOUT = frozenset("has have with no not without is show hide".split())
#: Beside a mark, these can be of the part itself or of the page's wrapper: the text decides.
STATES = frozenset("fixed sticky static open opened closed enabled disabled active visible left right top bottom layout wrapper wrap container page body theme grid site on off".split())
#: Names that even a single paragraph or an inline element has only if it is an advert or the like.
LEAF_NAMES = frozenset("adsbygoogle ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie newsletter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that aren't kept open: what follows ends them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 tr hr option caption legend summary figcaption".split())
#: Items that the next one ends, with what it ends and what they lie in.
_LIST, _TERMS, _CELLS = (frozenset(x.split()) for x in ("ul ol menu", "dl", "table"))
ITEMS = {"li": (frozenset(["li"]), _LIST), "dt": (frozenset(["dt", "dd"]), _TERMS), "dd": (frozenset(["dt", "dd"]), _TERMS), "td": (frozenset(["td", "th"]), _CELLS), "th": (frozenset(["td", "th"]), _CELLS), "tr": (frozenset(["td", "th"]), _CELLS)}
#: Children of a page that are parts of its text.
TEXTUAL = frozenset("ul ol dl table blockquote pre figure".split())
LISTS = frozenset("ul ol dl li dt dd".split())
#: What ends a head, or a control, that is never closed.
CONTROLS = frozenset("button select textarea title".split())
ENDS_CONTROL = frozenset("article main section p h1 h2 h3 h4 h5 h6 table ul ol footer nav".split())
ENDS_HEAD = BLOCKS - {"html"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: With one of these words, a header is the article's own, and an element may have headers of its own.
OWN = frozenset("article post entry story content main".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA, HOLDS = 1.0, 0.9

NO, WEAK, STRONG, READERS, SURE = range(5)  # how surely an element is apart


def _names(attrs: list[tuple[str, str | None]]) -> list[str]:
    return [name for k, v in attrs if v and k in ("class", "id", "role") for name in v.split()]


def _mark(attrs: list[tuple[str, str | None]]) -> int:
    """How surely an element's names say that it is apart."""
    found = NO
    for name in _names(attrs):
        parts = [x.lower() for x in _PART.findall(name)]
        at = next((k for k, x in enumerate(parts) if x in MARKS or x in COMMENTS), None)
        if at is None or not WITHOUT.isdisjoint(parts[:at]) or (parts[at] == "header" and not OWN.isdisjoint(parts)):
            continue
        found = max(found, READERS if not COMMENTS.isdisjoint(parts) else WEAK if not STATES.isdisjoint(parts) else STRONG)
    return found


class _Element:
    __slots__ = ("article", "mark", "parent", "tag")

    def __init__(self, tag: str, parent: int, mark: int) -> None:
        self.tag, self.parent, self.mark = tag, parent, mark
        self.article = tag in ("article", "main")


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [_Element("", -1, NO)]
        self.open = [0]  # numbers of elements
        self.many: Counter[str] = Counter()  # of each tag, how many are open
        self.own = 0  # open elements that may have headers of their own
        self.owners: set[int] = set()
        self.lines: list[tuple[str, int, int, int]] = []  # (text, characters in links, tags, element)
        self.headings: set[int] = set()  # lines
        self.leaf = ""  # the block that the line is in, if it is none of ``elements``
        self.titles: list[int] = []  # elements with an h1
        self.parts: list[str] = []
        self.linked = self.tags = self.links = 0
        self.hidden: str | None = None
        self.depth = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if self.leaf in HEADINGS and 2 * self.linked < len(text):
                self.headings.add(len(self.lines))
            self.lines.append((text, self.linked, self.tags, self.open[-1]))
            self.tags = self.linked = 0
        self.parts.clear()

    def _push(self, tag: str, mark: int, own: bool = False) -> None:
        self.elements.append(_Element(tag, self.open[-1], mark))
        self.open.append(len(self.elements) - 1)
        self.many[tag] += 1
        if own:
            self.owners.add(self.open[-1])
            self.own += 1

    def _pop(self) -> None:
        number = self.open.pop()
        self.many[self.elements[number].tag] -= 1
        self.own -= number in self.owners

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.hidden and tag in (ENDS_HEAD if self.hidden == "head" else ENDS_CONTROL if self.hidden in CONTROLS else ()):
            self.hidden = None  # never closed
        if self.hidden:
            self.depth += tag == self.hidden
        elif tag in HIDDEN:
            if tag == "head":
                self.end_line()
            self.hidden, self.depth = tag, 1
        elif tag in BLOCKS:
            self.end_line()
            self.leaf = tag
            if tag == "body":
                self.links = 0
            if tag not in ("html", "body"):
                self._block(tag, attrs)
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in VOID and not LEAF_NAMES.isdisjoint(_names(attrs)):
            self.end_line()  # an advert in a span is a line of its own
            self._push(tag, SURE)

    def _end_items(self, ended: frozenset[str], lists: frozenset[str]) -> None:
        """Closes the item before, if it is open in the innermost list."""
        if not any(self.many[t] for t in ended):
            return
        k = len(self.open) - 1
        while k and (tag := self.elements[self.open[k]].tag) not in lists and tag not in ended:
            k -= 1
        if k and tag in ended:
            while len(self.open) > k:
                self._pop()

    def _block(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.elements[self.open[-1]].tag in LEAVES:
            self._pop()
        if tag in ITEMS:
            self._end_items(*ITEMS[tag])
        if tag in LEAVES or tag in ITEMS:
            if tag == "h1":
                self.titles.append(self.open[-1])
            names = {n.lower() for n in _names(attrs)}
            apart = not LEAF_NAMES.isdisjoint(names) or (tag in ITEMS and not COMMENTS.isdisjoint(names))
            if apart or (tag in ITEMS and tag != "tr"):
                self._push(tag, SURE if apart else NO)
            return
        article = tag in ("article", "main")
        if article and not self.many["article"] and not self.many["main"] and not self.many["aside"]:
            self.links = 0
            apart = [self.many[t] for t in APART]
            while any(apart) and self.elements[self.open[-1]].tag in LISTS | APART:  # never closed
                self._pop()
                apart = [self.many[t] for t in APART]
        mark = _mark(attrs)
        own = article or any(not OWN.isdisjoint(x.lower() for x in _PART.findall(n)) for n in _names(attrs))
        if tag in APART:
            mark = mark if tag == "header" and self.own else SURE
        elif any(k == "hidden" for k, _ in attrs):
            mark = SURE
        self._push(tag, mark, own)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.hidden:
            self.depth -= tag == self.hidden
            if self.depth <= 0 or (self.hidden == "head" and tag == "html"):
                self.hidden = None
            return
        if tag == "a":
            self.links = 0
        known = self.many[tag] > 0
        if tag in BLOCKS or known:
            self.end_line()
            self.leaf = ""
            if known:
                while self.elements[self.open[-1]].tag != tag:
                    self._pop()
                self._pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, reach, mode="edge") if len(ratios) else ratios, kernel / kernel.sum(), mode="valid") if len(ratios) else ratios


def _below(elements: list[_Element], values: np.ndarray) -> np.ndarray:
    """Of a value of each element, the sum over what lies in it; elements are numbered after those that they lie in."""
    out = values.tolist()
    for number in range(len(elements) - 1, 0, -1):
        out[elements[number].parent] += out[number]
    return np.array(out)


def _apart(page: _Lines) -> list[bool]:
    """Whether each element is apart, itself or by what it lies in."""
    elements = page.elements
    sure = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        sure[k] = sure[e.parent] or e.mark == SURE
    text, heads = np.zeros(len(elements)), np.zeros(len(elements))
    for line, linked, _, number in page.lines:
        if not sure[number]:
            text[number] += max(len(line) - linked, 0)
    for number in page.titles:
        heads[number] += not sure[number]
    for k, e in enumerate(elements):
        # An article in its own right is as good a sign of a wrapper as a title.
        heads[k] += e.article and e.mark == NO and not sure[k]
    text, heads = _below(elements, text), _below(elements, heads)
    out = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        out[k] = out[e.parent] or (e.mark != NO and not _wraps(e, text[k], text[0], heads[k]))
    return out


def _wraps(e: _Element, text: float, whole: float, heads: float) -> bool:
    """Whether a marked element is a wrapper of the page, or an article, rather than a part that is apart."""
    if e.mark == SURE:
        return False
    if e.mark == WEAK:
        return 4 * text >= whole or heads > 0
    return 2 * text >= whole and (heads > 0 or (e.article and e.mark == STRONG))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    lines, elements = page.lines, page.elements
    apart = _apart(page)
    ratios = np.array([0.0 if apart[number] else max(len(text) - linked, 0) / max(tags, 1) for text, linked, tags, number in lines])
    if not ratios.any():
        return ""
    level = smooth(ratios)
    content = (level >= min(level.std(), level.max() / 2)) & (ratios > 0)
    if not content.any():
        content = ratios > 0
    own = np.zeros(len(elements))
    for k in np.flatnonzero(content):
        own[lines[k][3]] += len(lines[k][0])
    held = _below(elements, own)
    # The articles that aren't apart and lie in no other.
    inside = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        inside[k] = inside[e.parent] or (e.article and not apart[k] and held[k] > 0)
    if 2 * sum(held[k] for k, e in enumerate(elements) if inside[k] and not inside[e.parent]) >= held[0]:
        return "\n".join(line[0] for line in lines if inside[line[3]] and not apart[line[3]])
    least = max(k for k in range(len(elements)) if held[k] >= HOLDS * held[0])
    within = [False] * len(elements)
    within[least] = True
    for k in range(least + 1, len(elements)):
        within[k] = within[elements[k].parent]
    found = np.flatnonzero(content)
    first, last = int(found[0]), int(found[-1])
    # Of each element in it, the child of the least one that it lies in; of each child, the characters and those in links.
    child = [0] * len(elements)
    chars, links = np.zeros(len(elements)), np.zeros(len(elements))
    for k in range(least + 1, len(elements)):
        child[k] = k if elements[k].parent == least else child[elements[k].parent]
    for text, linked, _, number in lines:
        if not apart[number]:
            chars[child[number]] += len(text)
            links[child[number]] += linked

    def kept(k: int) -> bool:
        number = lines[k][3]
        if not within[number] or apart[number]:
            return False
        if first <= k <= last or number == least or held[child[number]] > 0 or k in page.headings:
            return True
        return 2 * links[child[number]] < chars[child[number]] and (least > 0 or elements[child[number]].tag in TEXTUAL)

    return "\n".join(line[0] for k, line in enumerate(lines) if kept(k))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
