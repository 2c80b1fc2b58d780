"""Main text of web pages by the distribution of text over lines of blocks.

Markup is stripped to one line a block element.  A line weighs its characters;
tags and whole class names can only take that weight away (menus, adverts, hidden
elements, lines of little but links), never from html, body, article or main.
The weights are summed over a sliding window of lines.  A run of windows that
leave zero is a surge up to its dive; a run that never sums to SURGE characters
is stray text.  The main text is all that weighs between the first surge and the
last dive of the other runs, however far apart they stand.

Article and main elements take the weight of the lines outside, unless those
hold more than TEASER times their text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters that a window must reach somewhere in a run for the run to be text.
SURGE = 20
LINK_SHARE = 0.8
TEASER = 4

#: Names of HTML elements by what they mean for text.
HIDDEN = frozenset("script style noscript template iframe object svg canvas head title select option button textarea datalist math audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that no class, id or role makes boilerplate.
CONTENT = MAIN | {"html", "body"}
#: Elements whose end tag may be left out: the openings that end them, and the containers that keep them from ending.
LISTS, TABLES = frozenset("ul ol menu".split()), frozenset(["table"])
IMPLIED = {"li": ({"li"}, LISTS), "td": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, TABLES), "th": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, TABLES), "tr": ({"tr", "tbody", "thead", "tfoot"}, TABLES), "dt": ({"dt", "dd"}, frozenset(["dl"])), "dd": ({"dt", "dd"}, frozenset(["dl"])), "option": ({"option"}, frozenset(["datalist"]))}
#: Whole class names, ids and roles that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe widget contentinfo complementary search".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|\Z)", re.I)
STYLED = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select", "math", "object", "canvas", "audio", "video", "button")}
#: Elements whose content is no markup; only these hide all that follows if never closed.
RAW = frozenset("script style textarea title".split())
#: An end tag beyond one of these belongs to another element.
BOUNDED = frozenset("button select object".split())
BOUND = re.compile(r"<(?:article|main|section|body|h[1-6]|button|select|object)\b|</(?:article|main|section|body|div|p|li|td|form)\b", re.I)


@dataclass
class Line:
    """A block's text, how many of its characters are link text, and where it stands."""

    text: str
    linked: int
    boilerplate: bool
    main: bool


def _marked(attributes: str) -> bool:
    """Whether an element is boilerplate by a whole class name, id or role, or is not shown."""
    if any(word.lower() in MARKS for m in MARKED.finditer(attributes) for word in (m[1] or m[2] or m[3] or "").split()):
        return True
    return "hidden" in attributes.lower() and UNSEEN.search(QUOTED.sub('""', attributes)) is not None or STYLED.search(attributes) is not None


def _collapse(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Open:
    """An open element and what it makes of the lines in it."""

    name: str
    boilerplate: bool
    main: bool
    inline: bool


OUTSIDE = Open("", False, False, False)


class _Lines:
    """Reads a page's tags into lines; tolerant of elements that are never closed."""

    def __init__(self, page: str):
        self.page, self.out, self.parts = page, [], []
        self.stack: list[Open] = []
        self.links, self.linked = 0, 0
        self.lowered, self.ends = None, {}

    def ends_after(self, name: str, at: int) -> bool:
        """Whether the page has an end tag of this name later on."""
        if name not in self.ends:
            self.lowered = self.page.lower() if self.lowered is None else self.lowered
            self.ends[name] = self.lowered.rfind(f"</{name}")
        return self.ends[name] >= at

    def top(self) -> Open:
        return self.stack[-1] if self.stack else OUTSIDE

    def end_line(self) -> None:
        text = _collapse("".join(self.parts))
        if text:
            self.out.append(Line(text, self.linked, self.top().boilerplate, self.top().main))
        self.parts.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        text = html.unescape(raw)
        self.parts.append(text)
        if self.links:
            self.linked += len(_collapse(text))

    def skipped(self, name: str, attributes: str, at: int) -> int:
        """Where the page goes on after an element that is not read."""
        if name in ("svg", "math") and attributes.endswith("/"):
            return at
        finish = RAW_END[name].search(self.page, at)
        if finish and name in BOUNDED and BOUND.search(self.page, at, finish.start()):
            finish = None
        # Without its end tag, a raw element hides the rest of the page and any other element nothing but its tag.
        return finish.end() if finish else len(self.page) if name in RAW else at

    def open_inline(self, name: str, attributes: str) -> None:
        """An unmarked inline element matters only where one of its name is open, whose end tag it must not take."""
        if name not in VOID and not attributes.endswith("/") and any(x.name == name for x in self.stack):
            self.stack.append(Open(name, self.top().boilerplate, self.top().main, True))

    def close_inline(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            held = self.stack[i]
            if held.name == name:
                below = self.stack[i - 1] if i else OUTSIDE
                if held.boilerplate != below.boilerplate:
                    self.end_line()
                del self.stack[i:]
                return
            if not held.inline:
                return

    def open_block(self, name: str, attributes: str, marked: bool, at: int) -> None:
        if name in BLOCK and name != "br" and self.top().name == "p":
            self.stack.pop()
        for i in range(len(self.stack) - 1, -1, -1):
            enders, _ = IMPLIED.get(self.stack[i].name, ((), ()))
            if name in enders:
                del self.stack[i:]
            elif any(name in IMPLIED[x][0] and self.stack[i].name in IMPLIED[x][1] for x in IMPLIED):
                break
        if name in VOID or attributes.rstrip().endswith("/") or name == "p" and not marked:
            return
        # A container of boilerplate that is never closed would take the rest of the page with it.
        closed = name == "p" or name in IMPLIED or self.ends_after(name, at)
        off = (marked or name in BOILERPLATE) and closed or name in HIDDEN
        self.stack.append(Open(name, self.top().boilerplate or off, self.top().main or name in MAIN, name not in BLOCK and name not in HIDDEN))

    def close_block(self, name: str) -> None:
        i = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].name == name), None)
        if i is not None:
            del self.stack[i:]
        if name in BOILERPLATE or name in MAIN:
            self.links = 0

    def read(self) -> list[Line]:
        at = 0
        while m := TOKEN.search(self.page, at):
            if m.start() > at:
                self.add(self.page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            closing, name, attributes = bool(m[1]), m[2].lower(), m[3] if m[3] is not None else m[4]
            if name in RAW_END and not closing:
                at = self.skipped(name, attributes, at)
            elif name == "a":
                self.links = max(0, self.links + (-1 if closing else 1))
            else:
                marked = not closing and name not in CONTENT and _marked(attributes)
                if name in BLOCK or name in HIDDEN or marked:
                    self.end_line()
                    if closing:
                        self.close_block(name)
                    else:
                        self.open_block(name, attributes, marked, at)
                elif closing:
                    self.close_inline(name)
                else:
                    self.open_inline(name, attributes)
        if at < len(self.page):
            self.add(self.page[at:])
        self.end_line()
        return self.out


def lines(page: str) -> list[Line]:
    """The page as lines, in page order."""
    return _Lines(page).read()


def weights(found: list[Line]) -> np.ndarray:
    """The characters that each line counts for."""
    seen = np.array([0 if x.boilerplate else len(x.text) for x in found], np.int64)
    inside = np.array([x.main for x in found], bool)
    loose = np.array([0 if x.linked >= LINK_SHARE * len(x.text) else n for x, n in zip(found, seen.tolist())], np.int64)
    held = int(seen[inside].sum())
    if held and int(loose[~inside].sum()) <= TEASER * held:
        return np.where(inside, seen, 0)
    return np.where(inside, seen, loose) if held or loose.any() else seen


def span(sizes: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """[first surge, last dive): the lines from the first run of windows that sums to ``surge`` to the end of the last.

    A run begins where the sum of ``window`` lines leaves zero and ends where it
    falls to it again.  Where no run sums to ``surge``, all runs count.
    """
    sums = np.convolve(sizes, np.ones(window, np.int64))
    filled = np.concatenate(([False], sums > 0, [False]))
    surges, dives = np.flatnonzero(filled[1:] & ~filled[:-1]), np.flatnonzero(filled[:-1] & ~filled[1:])
    if not len(surges):
        return 0, 0
    strong = np.maximum.reduceat(sums, surges) >= surge
    strong = strong if strong.any() else ~strong
    return int(surges[strong][0]), int(dives[strong][-1]) - window + 1


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines that weigh between the first surge and the last dive, joined by one space; empty if there are none.

    Null, empty and text-free pages give an empty text.
    """
    found = lines(page or "")
    if not found:
        return ""
    sizes = weights(found)
    first, last = span(sizes, window, surge)
    return " ".join(found[i].text for i in range(first, last) if sizes[i])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row with page_id, url and html.

    Cases: a null or empty html gives an empty text; rows with null or repeated
    page_ids give a row each; a page of any length is read whole; other columns,
    whatever their names, are not read; an empty table gives an empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")
