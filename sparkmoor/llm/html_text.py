"""Main text of web pages by text-to-tag ratios.

*Events.*  The standard library's parser is fed a page in parts and its events are turned into lines:
what stands between two borders of block elements.  A line knows its text, how many tags it took,
how much of it is link text, in which element it stands, and whether that element is named as
something else than the article (menus, banners, forms, remarks of readers, and so on).

*Ratios.*  A line's ratio is its characters per tag.  Ratios are smoothed over neighbouring lines by a
Gaussian, and lines are clustered by a threshold at the standard deviation of the smoothed ratios:
those above are content, those below are not.

*Regions.*  The region is the element in which the content lines are: the ``article`` or ``main``
with the most characters of them, or, on pages without one, the innermost element that holds three
quarters of them.  All its lines are taken, short ones too, but for elements named as something else
and for runs of lines that are nothing but links and lie below the threshold themselves.

The parser works on a row at a time, so a task holds one page at once; nothing is shuffled.

Defined cases: a null or empty page has the empty text, and so has a page without text; markup cut
off at the end is dropped; characters that cannot be are U+FFFD; where no line would be left because
names hide all of them, names other than those of elements are not regarded.  Rows that repeat are
worked twice, an empty table gives no rows, other columns stay whatever they are called.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_row

CHUNK = 1 << 16          # characters fed to the parser at a time
RADIUS = 1               # of the Gaussian, in lines
SHARE = 0.75             # of the content that a region without a name holds
LINKS_IN_A_ROW = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option
    p pre section select summary table tbody td tfoot th thead title tr ul""".split())
CONTAINERS = frozenset("article body center div dl fieldset figure html li main ol section table td ul".split())
NOT_TEXT = frozenset("""audio button canvas datalist iframe noscript object script select style svg template textarea
    title video""".split())
ELSEWHERE = frozenset("aside dialog footer form menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status".split())
# words of a class or id; an article within the first kind is the page's own all the same
LAYOUT = frozenset("""alert aside banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead
    menu menus modal nav navbar navigation notice notices overlay pager pagination popup rail search sidebar signup
    toolbar widget""".split())
STRANGE = frozenset("""ad ads adv advert advertisement advertising adverts comment comments disqus newsletter promo
    promoted promotion recommended related replies reply share sharing social sponsor sponsored subscribe""".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

NO, BY_LAYOUT, BY_NAME, BY_ELEMENT = range(4)   # what hides a line, the stronger the higher


class Line(NamedTuple):
    text: str
    tags: int
    linked: int      # characters of link text
    element: int     # innermost container
    hidden: int


class Page(NamedTuple):
    lines: list[Line]
    parents: list[int]   # of containers, -1 for the root
    named: list[bool]    # containers that are an article or the main part


class _Frame(NamedTuple):
    tag: str
    element: int
    hidden: int
    inside: bool    # an article or main part


class Reader(HTMLParser):
    """Turns events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page([], [-1], [False])
        self.stack = [_Frame("", 0, NO, False)]
        self.open: dict[str, int] = {}
        self.words: list[str] = []
        self.tags = self.linked = self.links = 0

    # lines

    def _border(self) -> None:
        text = " ".join("".join(self.words).split()) if self.words else ""
        if text:
            top = self.stack[-1]
            self.page.lines.append(Line(text, max(1, self.tags), self.linked, top.element, top.hidden))
            self.tags = 0
        self.words, self.linked = [], 0

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.tag in NOT_TEXT:
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data)

    # elements

    def _push(self, frame: _Frame) -> None:
        self.stack.append(frame)
        self.open[frame.tag] = self.open.get(frame.tag, 0) + 1

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._border()
            while self.stack[-1].tag in ("p", "title", "span", "a") or (tag == "option" and self.stack[-1].tag == tag):
                self._pop()          # these end where a block begins
            self.links = 0
            if tag == "li" and self.stack[-1].tag == "li":
                self._pop()
        elif tag == "br":
            self.words.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        top = self.stack[-1]
        hidden, inside = self._hides(tag, attrs, top)
        if tag in CONTAINERS or tag in ELSEWHERE or tag == "header":
            self.page.parents.append(top.element)
            self.page.named.append(tag in ("article", "main"))
            self._push(_Frame(tag, len(self.page.parents) - 1, hidden, inside))
        elif tag in NOT_TEXT or hidden != top.hidden:
            self._push(_Frame(tag, top.element, hidden, inside))

    def _hides(self, tag: str, attrs: list[tuple[str, str | None]], top: _Frame) -> tuple[int, bool]:
        hidden, inside = top.hidden, top.inside
        if tag in ("article", "main"):
            if tag == "article" and inside and self.open.get("article"):
                return BY_ELEMENT, True              # an article in an article is a remark on it
            if hidden == BY_LAYOUT or (hidden == BY_ELEMENT and top.tag in ("form", "nav")):
                hidden = NO
            inside = True
        elif tag in ELSEWHERE or tag in NOT_TEXT or (tag == "header" and not inside):
            return BY_ELEMENT, inside
        if tag not in ("html", "body", "main"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    words = {w.lower() for w in WORD.findall(value)}
                    if words & STRANGE:
                        hidden = max(hidden, BY_NAME)
                    elif words & LAYOUT and tag != "article" and not (inside and "header" in words):
                        hidden = max(hidden, BY_LAYOUT)
                elif (name == "role" and (value or "").lower() in ROLES) or name == "hidden" or \
                        (name == "aria-hidden" and value == "true") or \
                        (name == "style" and "display:none" in (value or "").replace(" ", "").lower()):
                    hidden = max(hidden, BY_NAME)
        return hidden, inside

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.words.append(" ")
        if tag in BLOCKS:
            self._border()
            self.links = 0
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)   # what HTML says about "<!["

    def read(self, html: str) -> Page:
        for at in range(0, len(html), CHUNK):
            self.feed(html[at:at + CHUNK])
        if self.cdata_elem or re.match(r"<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""                        # cut off within markup
        self.close()
        self._border()
        return self.page


def ratios(lines: list[Line]) -> np.ndarray:
    """Smoothed characters per tag."""
    raw = np.array([len(x.text) / x.tags for x in lines])
    steps = np.arange(-3 * RADIUS, 3 * RADIUS + 1)
    kernel = np.exp(-(steps / RADIUS) ** 2 / 2)
    around = np.convolve(raw, kernel)[3 * RADIUS:len(raw) + 3 * RADIUS]
    return around / np.convolve(np.ones(len(raw)), kernel)[3 * RADIUS:len(raw) + 3 * RADIUS]


def _region(page: Page, seen: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which elements belong to the region, given the visible lines and those that are content."""
    n = len(page.parents)
    parents = np.array(page.parents)
    size = np.array([len(x.text) for x in page.lines])
    at = np.array([x.element for x in page.lines])
    mass = np.bincount(at[seen & content], size[seen & content], n)
    text = np.bincount(at[seen], size[seen], n)
    for child in range(n - 1, 0, -1):                # parents come before their children
        mass[parents[child]] += mass[child]
        text[parents[child]] += text[child]
    named = np.flatnonzero(np.array(page.named) & (text > 0))
    if len(named):
        best = max(named.tolist(), key=lambda e: (mass[e], text[e], e))   # of equals the innermost
        for e in named.tolist():                     # an article that is most of the main part
            p = parents[e]
            while p > 0 and p != best:
                p = parents[p]
            if p == best and 2 * mass[e] >= mass[best] and mass[e] > 0:
                best = e
    else:
        best = 0
        children: dict[int, list[int]] = {}
        for e in range(1, n):
            children.setdefault(page.parents[e], []).append(e)
        while inner := [e for e in children.get(best, ()) if mass[e] > 0 and mass[e] >= SHARE * mass[best]]:
            best = inner[0]
    inside = np.zeros(n, bool)
    inside[best] = True
    for e in range(best + 1, n):
        inside[e] = inside[page.parents[e]]
    return inside


def select(page: Page) -> np.ndarray:
    """Which lines are the main text."""
    lines = page.lines
    if not lines:
        return np.zeros(0, bool)
    hidden = np.array([x.hidden for x in lines])
    smooth = ratios(lines)
    content = smooth >= smooth.std()
    seen = hidden == NO
    for allowed in (BY_LAYOUT, BY_NAME):
        if not seen.any():
            seen = hidden <= allowed
    if not seen.any():
        return seen
    inside = _region(page, seen, content)
    take = seen & inside[[x.element for x in lines]]
    only_link = np.array([x.linked >= len(x.text) and len(x.text) / x.tags < smooth.std() for x in lines]) & take
    edges = np.flatnonzero(np.diff(np.concatenate([[False], only_link, [False]])))
    for a, z in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        if z - a >= LINKS_IN_A_ROW:
            take[a:z] = False
    return take


_LONG_NUMBER, _ZEROS = re.compile(r"&#[0-9]{8,}"), re.compile(r"&#0+(?=[0-9])")


def read(html: str | None) -> Page:
    html = _LONG_NUMBER.sub("&#x7fffffff", _ZEROS.sub("&#", html)) if html and "&#" in html else html
    return Reader().read(html or "")


def main_text(html: str | None) -> str:
    """The blocks of the main text, one a line."""
    page = read(html)
    return "\n".join(page.lines[i].text for i in np.flatnonzero(select(page)).tolist())


def with_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Append the main text of every page, under ``name`` or, where that is taken, a longer one."""
    return per_row(pages, lambda: lambda rows: [(main_text(h),) for h in rows], [html], f"`{fresh(pages, name)}` string")


def line_report(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line, n_chars, n_tags, ratio, kept, text) of every line, to see why a page came out as it did."""
    def report(h: str | None) -> list[dict]:
        page = read(h)
        smooth = ratios(page.lines).tolist() if page.lines else []
        return [{"line": i, "n_chars": len(x.text), "n_tags": x.tags, "ratio": r, "kept": k, "text": x.text}
                for i, (x, r, k) in enumerate(zip(page.lines, smooth, select(page).tolist()))]

    rows = per_row(pages.select(key, F.col(html).alias("_html")), lambda: lambda hs: [(report(h),) for h in hs], ["_html"],
                   "_lines array<struct<line:int,n_chars:int,n_tags:int,ratio:double,kept:boolean,text:string>>")
    return rows.select(key, F.explode("_lines").alias("_line")).select(key, "_line.*")
