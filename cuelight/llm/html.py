"""Main text of web pages by the distribution of text over lines.

Markup is stripped to one line a block, and each line has a length: that of its
own text, not that of links outside paragraphs and headings. The lengths are
summed over a sliding window of lines. Where the sum surges over ``SURGE`` main
text begins, where it dives to nothing it ends; what lies between is kept, its
lines of links included.

Markup only gives the lines weights:

- Lines of menus, footers, asides, page headers, scripts and hidden elements weigh
  nothing, by their elements.
- Neither do lines of forms, and of elements whose class, id or role names a menu,
  sidebar, notice, advert or the like; but an element that holds most of the text,
  with no article elsewhere, is taken for a frame of the page and its name is void.
  So is the name of a heading, and a name of what a frame has (``has-sidebar``).
- Where elements mark an article that has text, all their lines are main text and no others are:
  the page says itself where it surges and dives.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import small_text_batches, text_of

#: Lines of a window, and the text in it that makes a surge.
WINDOW, SURGE = 3, 80

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")

#: Elements whose content isn't markup, and is no text either.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that are never main text.
NOT_TEXT = frozenset("head nav header footer aside button select option menu svg canvas object audio video map datalist".split())
#: Elements that are seldom main text, unless a page is framed by one.
DOUBTFUL = frozenset("form fieldset dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose links are part of the text.
TEXT = HEADINGS | {"p", "blockquote", "figcaption"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
ARTICLE = frozenset(("article", "main"))
#: Words in a class or id of what isn't main text.
COMMENTS = frozenset("comment comments commentlist disqus respond responses replies reply".split())
MARKS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox banner billboard breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended related search share sharing sidebar sidenav signup social sponsor sponsored "
    "subscribe subscription tags toc toolbar topbar topnav widget widgets alert".split()
)
#: Words beside those in a name that say where or how such a thing stands. A name with any other word is of something else: ``share-price``.
BESIDE = frozenset(
    "area article articles aside bar block blocks body bottom box btn button buttons col column container content count entry fixed footer form group hd head header icon icons "
    "inner item items js large layer left link links list main media mini mobile module nav next outer page panel post posts prev primary right row section secondary site slot small "
    "stories sticky story text title toggle top unit wrap wrapper zone".split()
)
#: First words of a class that says what an element has, not what it is.
HAVING = frozenset("has have with without no not is are show hide hides shows js".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar".split())
DOUBTFUL_ROLES = frozenset("dialog form".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that a start tag ends where they are the innermost block.
ENDS = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "option": {"option"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}}


def named(value: str) -> str:
    """``comments``, ``other`` or nothing, for the words of a class or id."""
    kind = ""
    for part in value.split():
        words = WORDS.findall(CAMEL.sub("-", part).lower())
        if words and words[0] not in HAVING and all(w in MARKS or w in BESIDE for w in words):
            if any(w in COMMENTS for w in words):
                return "comments"
            if any(w in MARKS for w in words):
                kind = "other"
    return kind


def role_of(name: str, attributes: str) -> str:
    """What a start tag says of its element: ``skip``, a doubtful ``comments`` or ``other``, ``article``, or nothing."""
    kind = "skip" if name in NOT_TEXT else "other" if name in DOUBTFUL else "article" if name in ARTICLE else ""
    if not attributes or name in ("html", "body"):
        return kind
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "skip"
        if key == "role":
            if value.lower() in ROLES:
                return "skip"
            if value.lower() in DOUBTFUL_ROLES:
                kind = kind or "other"
            elif value.lower() in ("main", "article"):
                kind = kind or "article"
        elif key in ("class", "id") and name not in HEADINGS and kind != "skip":
            kind = named(value) or kind
    return kind


class Line(NamedTuple):
    text: str
    own: int  #: length, without links outside of paragraphs and headings
    skipped: bool
    article: bool
    doubt: int  #: the innermost element with a doubtful name, -1 for none


class Page:
    """Lines of a page in order, and its doubtful elements: the enclosing one of each, its kind, whether an article lies in it."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.doubts: list[list] = []
        self._open: list[tuple[str, str, int]] = []  # name, role, doubt outside
        self._count: Counter[str] = Counter()  # open elements by name
        self._roles: Counter[str] = Counter()
        self._doubt, self._texts, self._links, self._own, self._parts = -1, 0, 0, 0, []
        self._read(page)

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            self.lines.append(Line(text, self._own, self._roles["skip"] > 0, self._roles["article"] > 0, self._doubt))
        self._parts.clear()
        self._own = 0

    def _add(self, raw: str) -> None:
        text = references.unescape(raw)
        self._parts.append(text)
        if not self._links or self._texts:
            self._own += len(text.strip())

    def _push(self, name: str, role: str) -> None:
        outside = self._doubt
        if role in ("comments", "other"):
            self.doubts.append([outside, role, False])
            self._doubt = len(self.doubts) - 1
        elif role == "article" and outside >= 0:
            self.doubts[outside][2] = True
        self._open.append((name, role, outside))
        self._count[name] += 1
        self._roles[role] += 1
        self._texts += name in TEXT

    def _pop(self) -> str:
        if self._open[-1][1]:
            self._flush()
        name, role, outside = self._open.pop()
        self._count[name] -= 1
        self._roles[role] -= 1
        self._texts -= name in TEXT
        self._doubt = outside
        return name

    def _end(self, name: str) -> None:
        """An end tag ends what is open in its element; that of an inline element no block."""
        if not self._count[name]:
            return
        if name not in BLOCK:
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == name:
                    break
                if self._open[k][0] in BLOCK:
                    return
        while self._pop() != name:
            pass

    def _start(self, name: str, attributes: str) -> None:
        role = role_of(name, attributes)
        if role == "skip" and name == "header" and self._roles["article"]:
            role = ""
        if role:
            self._flush()
        self._push(name, role)

    def _read(self, page: str) -> None:
        at, n, lower = 0, len(page), None
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                self._add(page[at:])
                break
            if m.start() > at:
                self._add(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in RAW and not closing:
                if lower is None:
                    lower = page.lower()
                    if len(lower) != n:  # a letter whose lower case is longer
                        lower = re.sub("[A-Z]", lambda c: c[0].lower(), page)
                end = lower.find("</" + name, at)
                if end < 0:
                    break
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            elif name == "br":
                self._parts.append(" ")
            elif name == "a":
                self._links = 0 if closing else 1
            elif name in VOID or attributes.endswith("/") and name not in BLOCK:
                continue
            elif closing:
                if name in BLOCK:
                    self._flush()
                self._end(name)
            else:
                if name in BLOCK:
                    self._flush()
                    ends = ENDS.get(name, {"p"})
                    while self._open and (self._open[-1][0] in ends or self._open[-1][0] not in BLOCK and not self._open[-1][1]):
                        self._pop()
                self._start(name, attributes)
        self._flush()

    def skipped(self) -> list[bool]:
        """Whether each line is outside the main text by what its elements say and how much text they hold."""
        mass = [0] * len(self.doubts)
        inside = [0] * len(self.doubts)  # of it in articles
        for line in self.lines:
            if not line.skipped and line.doubt >= 0:
                mass[line.doubt] += line.own
                inside[line.doubt] += line.own * line.article
        holds = [d[2] for d in self.doubts]
        for k in range(len(mass) - 1, -1, -1):  # an element comes after those around it
            outside = self.doubts[k][0]
            if outside >= 0:
                mass[outside] += mass[k]
                inside[outside] += inside[k]
                holds[outside] |= holds[k]
        whole = sum(line.own for line in self.lines if not line.skipped)
        marked = sum(line.own for line in self.lines if not line.skipped and line.article)
        gone: list[bool] = []
        for k, (outside, kind, _) in enumerate(self.doubts):
            frame = mass[k] * 2 > whole and marked <= inside[k] and (kind == "other" or holds[k])
            gone.append(outside >= 0 and gone[outside] or not frame)
        return [line.skipped or line.doubt >= 0 and gone[line.doubt] for line in self.lines]


def spans(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Lines from a surge to a dive, first and last, of every stretch.

    A stretch starts with the first line of a window whose sum is over ``surge`` and ends before the window
    that sums to nothing. If no window is, half of the greatest sum is the measure.
    """
    total, sums = 0, []
    for k in range(len(lengths) - 1, -1, -1):
        total += lengths[k] - (lengths[k + window] if k + window < len(lengths) else 0)
        sums.append(total)
    sums.reverse()
    needed = min(surge, max(sums, default=0) / 2)
    out, first = [], -1
    for k, total in enumerate([*sums, 0]):
        if first < 0:
            first = k if total > needed else -1
        elif not total:
            own = [i for i in range(first, k) if lengths[i]]
            out.append((own[0], own[-1]))
            first = -1
    return out


def main_lines(page: Page) -> list[int]:
    """The lines of the main text: a marked article's, or else those between surges and dives."""
    skipped = page.skipped()
    inside = [k for k, line in enumerate(page.lines) if line.article and not skipped[k]]
    if any(page.lines[k].own for k in inside):
        return inside
    lengths = [0 if skip else line.own for line, skip in zip(page.lines, skipped)]
    return [k for first, last in spans(lengths) for k in range(first, last + 1) if not skipped[k]]


def main_text(page: str) -> str:
    """The blocks of the main text, joined by an empty line; empty where there is none."""
    read = Page(page)
    return "\n\n".join(read.lines[k].text for k in main_lines(read))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A null page is empty; a page without main text gives an empty text. Pages cut
    off anywhere are read to their end. Repeated rows give repeated rows, an empty
    table an empty result; other columns are not read, and nothing is shuffled.
    """
    small_text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(main_text)

    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), extract(text_of(html)).alias("text")).select(
        "*", F.char_length("text").cast("long").alias("n_chars")
    )
