"""Main text of HTML pages by the distribution of text over line blocks.

The markup is stripped to lines: every block-level element begins a new line, inline elements
do not, and markup alone makes no line.  A line weighs its text; links weigh nothing unless the line is as
long as a sentence (``SENTENCE``), is prose (a paragraph, a heading) or lies inside ``article`` or ``main``.

Elements that may be boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are
marked by their name, or by a class, id or role made of nothing but known words: ``site-footer`` is a mark,
``has-sidebar`` and ``share price`` are not.  The weights of the lines then judge the marks.  A marked element
whose lines weigh more than ``OUTWEIGHS`` times all unmarked ones, and that holds what an article is made of, is the
text itself (a form around the page, a layout class).  The other marked ones leave one empty line.

The weight of a line block is that of ``WINDOW`` consecutive lines.  The text surges where a block first weighs
something and dives where a whole block weighs nothing; the text between each surge and its dive is
kept, and what dives (lists of links) is left out.  A page on which nothing surges keeps its lines.

One pass over each page, in time linear in its length, no shuffle.  Edge cases: a null or empty page gives an
empty text; unclosed elements end with their parent or the page; scripts, styles and comments without
an end reach to the next tag, other opaque elements (``OPAQUE``) without one are only a tag; repeated rows are
extracted each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm.common import prepare

#: consecutive lines of a block
WINDOW = 3
#: characters from which a line of links counts as text
SENTENCE = 80
#: a marked element is the text if it weighs this many times all that is unmarked
OUTWEIGHS = 3
#: a tag; quotes count after "=" only, and where they never close, the next ">" ends the tag
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?=>)|[^>]*+)>|<(!--|[!?])")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
BLANK = re.compile(r"\s+")
WORDS = re.compile(r"[-_]+")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is not text; of the first ones the content is no markup either
RAW = frozenset("script style textarea template".split())
OPAQUE = RAW | frozenset("noscript svg iframe object".split())
#: elements that end where one of the same name, or for ``p`` any block, begins
SIBLING = frozenset("p li dt dd tr td th option".split())
IN_PARAGRAPH = frozenset("body caption dd dt head html legend li option summary tbody td tfoot th thead title tr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
MAIN = frozenset(["article", "main"])
#: what marks an element: never text; text if it holds an article; comments; a strong word; a weak word or name
NEVER, STRICT, COMMENTS, STRONG, WEAK = range(1, 6)
NAMES = {**dict.fromkeys("head title".split(), NEVER), **dict.fromkeys("nav footer button select menu".split(), STRICT),
         **dict.fromkeys("header aside form dialog".split(), WEAK)}
ROLES = dict.fromkeys("alertdialog banner complementary contentinfo dialog menu menubar navigation search".split(), WEAK)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion sidebar navbar navigation breadcrumb breadcrumbs cookie cookies consent popup newsletter masthead contentinfo complementary".split())
WEAK_WORDS = frozenset("banner menu nav header footer notice notices modal subscribe share social related recommended login search".split())
#: words that say nothing beside those
NEUTRAL_WORDS = frozenset("area articles bar block bottom box button buttons container content global group holder icons inner item items left links list main module outer panel policy posts primary reader readers right row secondary section signup site slot small stories thread top unit user widget widgets wrap wrapper".split())
HEADER = frozenset(["header", "masthead"])


def _name_kind(name: str) -> int | None:
    """Kind of one class name or id: 0 says nothing, None has a word that is not known."""
    words = [w.rstrip("0123456789") for w in WORDS.split(name.lower())]
    kind = 0
    for w in words:
        own = COMMENTS if w in COMMENT_WORDS else STRONG if w in STRONG_WORDS else WEAK if w in WEAK_WORDS else 0
        if not own and w and w not in NEUTRAL_WORDS:
            return None
        kind = min(kind, own) if kind and own else kind or own
    return kind


@lru_cache(4096)
def _attributes_kind(attributes: str) -> tuple[int, bool]:
    """(kind or 0, whether only words for headers say so) of class, id and role."""
    best, heads = 0, True
    for m in ATTRIBUTE.finditer(attributes):
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "role":
            kinds = [(ROLES.get(value.strip().lower(), 0), value)]
        elif what in ("class", "id"):
            kinds = [(_name_kind(v), v) for v in value.split()]
            if any(k is None for k, _ in kinds):  # a weak word needs a list of known names
                kinds = [(k, v) for k, v in kinds if k and k != WEAK]
        else:
            continue
        for kind, v in kinds:
            if kind:
                best = min(best, kind) if best else kind
                heads = heads and bool(HEADER & set(WORDS.split(v.lower())))
    return best, heads


def _mark(name: str, attributes: str, inside: bool) -> int:
    """Kind of an element's mark, or 0; ``inside`` an article a header may hold its title."""
    kind = NAMES.get(name, 0)
    if kind and not (inside and name == "header"):
        return kind
    if not attributes or name in ("html", "body", *MAIN):
        return 0
    kind, heads = _attributes_kind(attributes)
    if inside and heads or kind == WEAK and name not in BLOCK:
        return 0
    return kind


def _clean(words: list[str]) -> str:
    return BLANK.sub(" ", html.unescape("".join(words))).strip()


class _Ends:
    """Places of the ends of opaque parts, found once for each kind."""

    def __init__(self, page: str):
        self.page, self.of = page, {}

    def after(self, end: str, at: int) -> int | None:
        """Where the first ``end`` from ``at`` on is over."""
        if end not in self.of:
            self.of[end] = [(m.start(), m.end()) for m in re.finditer(re.escape(end) + (r"\s*>" if end.startswith("</") else ""), self.page, re.I)]
        k = bisect_left(self.of[end], (at,))
        return self.of[end][k][1] if k < len(self.of[end]) else None


class _Page:
    """The page's words by line; a word is (text, mark, whether it weighs), a mark -1 or its number in ``kinds``."""

    def __init__(self, page: str):
        self.lines: list[list[tuple[str, int, bool]] | int] = []  # a number: here a marked block begins
        self.kinds: list[int] = []
        self.holds: list[list[int]] = []  # articles, first headings, paragraphs in each mark
        self._words: list[tuple[str, int, bool]] = []
        self._read(page)

    def _end_line(self) -> None:
        if self._words:
            self.lines.append(self._words)
            self._words = []

    def _read(self, page: str) -> None:
        ends = _Ends(page)
        open_: list[tuple[str, int, bool, bool]] = []  # name; mark, article, link around it
        places: dict[str, list[int]] = {}  # places in open_ by name
        blocks: list[int] = []
        mark, inside, link, at = -1, False, False, 0
        stop = page.rfind(">") + 1  # no tag ends after it

        def close(place: int) -> None:
            nonlocal mark, inside, link
            while len(open_) > place:
                name, mark, inside, link = open_.pop()
                places[name].pop()
                if blocks and blocks[-1] == len(open_):
                    blocks.pop()

        while m := TAG.search(page, at, stop):
            if m.start() > at:
                self._words.append((page[at:m.start()], mark, inside or not link or bool(blocks) and open_[blocks[-1]][0] in PROSE))
            at = m.end()
            if m[4]:  # a comment or declaration
                end = ends.after("-->" if m[4] == "!--" else ">", at)
                at = end if end else self._next_tag(page, at, stop)
                self._words.append((" ", mark, False))
                continue
            name = m[2].lower()
            if name in OPAQUE:
                self._words.append((" ", mark, False))
                if not m[1] and not m[3].endswith("/"):
                    end = ends.after("</" + name, at)
                    at = end if end else self._next_tag(page, at, stop) if name in RAW else at
                continue
            if name == "br":
                self._words.append(("\n", mark, False))
                continue
            if name in BLOCK:
                self._end_line()
            own = places.setdefault(name, [])
            if m[1]:
                if own and (name in BLOCK or not blocks or blocks[-1] < own[-1]):  # inline ends close no block
                    close(own[-1])
                continue
            if name in BLOCK and name not in ("head", "title"):
                for outer in ("head", "title"):
                    if places.get(outer):
                        close(places[outer][-1])
                top = open_[blocks[-1]][0] if blocks else ""
                if top in SIBLING and (top == name or top == "p" and name not in IN_PARAGRAPH):
                    close(blocks[-1])
            if mark >= 0 and name in ("article", "main", "h1", "p"):
                self.holds[mark][0 if name in MAIN else 1 if name == "h1" else 2] += 1
            if name in VOID or m[3].endswith("/"):
                continue
            own.append(len(open_))
            if name in BLOCK:
                blocks.append(len(open_))
            open_.append((name, mark, inside, link))
            kind = _mark(name, m[3], inside)
            if kind:
                mark = len(self.kinds)
                self.kinds.append(kind)
                self.holds.append([0, 0, 0])
                if name in BLOCK:
                    self.lines.append(mark)
            inside = inside or name in MAIN
            link = link or name == "a" and "href" in m[3].lower()
        if at < len(page):
            self._words.append((page[at:], mark, inside or not link or bool(blocks) and open_[blocks[-1]][0] in PROSE))
        self._end_line()

    @staticmethod
    def _next_tag(page: str, at: int, stop: int) -> int:
        m = TAG.search(page, at, stop)
        return m.start() if m else len(page)

    def texts(self) -> list[bool]:
        """Which marks are text, judged by what their own lines weigh."""
        weight = [0] * (len(self.kinds) + 1)  # the last: unmarked
        for line in self.lines:
            if isinstance(line, int):
                continue
            for mark in {w[1] for w in line}:
                weight[mark] += _weigh([w for w in line if w[1] == mark])[1]
        out = []
        for kind, own, (articles, heads, paragraphs) in zip(self.kinds, weight, self.holds):
            heavy = own > OUTWEIGHS * weight[-1]
            alone = own > 0 == weight[-1]
            out.append(kind != NEVER and (articles > 0 and (alone if kind == COMMENTS else heavy)
                                          or heavy and kind in (STRONG, WEAK) and (heads > 0 or paragraphs >= (3 if kind == STRONG else 1))))
        return out


def _weigh(line: list[tuple[str, int, bool]]) -> tuple[str, int]:
    text = _clean([w[0] for w in line])
    return text, len(text) if len(text) >= SENTENCE or all(w[2] for w in line) else len(_clean([w[0] for w in line if w[2]]))


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, weight) of every line with text, and an empty one for each boilerplate element."""
    read = _Page(page)
    kept = [*read.texts(), True]  # the last: unmarked
    out: list[tuple[str, int]] = []
    for line in read.lines:
        if isinstance(line, int):
            if not kept[line]:
                out.append(("", 0))
            continue
        text, weight = _weigh([w for w in line if kept[w[1]]])
        if text:
            out.append((text, weight))
    return out


def regions(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(weight, first line, last line (exclusive)) of the text between each surge and its dive."""
    out, at, n = [], 0, len(weights)
    while at < n:
        if not weights[at]:
            at += 1
            continue
        begin, last, total = at, at, 0
        while at < n and at - last <= window:  # a whole empty block ends it
            if weights[at]:
                last, total = at, total + weights[at]
            at += 1
        out.append((total, begin, last + 1))
        at = max(at, last + 1)
    return out


def region(weights: list[int], window: int = WINDOW) -> tuple[int, int]:
    """First and last line (exclusive) between the surge and the dive that hold the most text."""
    return max(regions(weights, window), key=lambda r: r[0], default=(0, 0, 0))[1:]


def main_text(page: str | None, window: int = WINDOW) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    parts = regions([weight for _, weight in lines], window) or [(0, 0, len(lines))]
    return "\n\n".join(text for _, a, b in parts for text, _ in lines[a:b] if text)


def extract(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            found = [main_text(h, window) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
