"""Main text of web pages: the maximum-scoring contiguous run of a page's words and tags.

A page becomes a sequence of text chunks and tags. A chunk scores its number of words; a tag scores below zero, by a prior
for its kind and by what labelled pages show: tags that stand outside the content more often than inside cost more, by
the logarithm of the ratio. Pages label themselves where they mark their content once (``article``, ``main`` or
``itemprop=articleBody``); all such pages are counted. Where a page's one mark holds a fair share of its words, tags inside
cost nothing and words outside score nothing. One linear scan finds the best run.

Elements that usually are no content (menus, side bars, forms, adverts, comments, ... by tag, class or id) score nothing and are
left out of the text, unless they hold the page's mark or most of its words, as a form around a whole page does. A class or id
is such a name as a whole, or if its other parts say nothing (``site-footer``, but not ``has-sidebar`` or ``related-work``). Such
an element that is never closed counts as ordinary, so that a broken page isn't lost. Scripts, styles, comments and the head
are no text; a head without an end ends at the first element of a body.

Character references are decoded; white space is one space inside a block; blocks are joined by one space. Null and
empty pages, and such without any word, give an empty text. Repeated rows are treated alike.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.llm.common import with_columns

#: Most frequent tags and names that have weights.
MOST_NAMES = 20_000
#: Names that a task counts before it hands them on.
HELD_NAMES = 200_000
#: Share of a page's words from which an element is no side matter, and from which a page's one mark is no teaser.
MOST, TEASER = 0.8, 0.2
#: Words that a tag costs for each factor e by which it is more frequent outside than inside.
STEP = 4.0
#: Class and id names are learned from this number of occurrences on.
LEAST = 20
#: Stands for a script or the like that was cut out; it parts the words beside it.
CUT = "#cut"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe)(?=[\s/>])(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![\w:-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_MARKED = re.compile(r"""\bitemprop\s*=\s*["']?articleBody""", re.I)

# --- fixed values: HTML element names by their part in a page, and usual names of what is no content
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 header blockquote pre ul ol li dl dd dt table tbody thead tr td th figure figcaption br hr".split())
FRAME = frozenset("article main body html footer nav aside".split())
NEVER = frozenset("nav aside footer form button select menu dialog svg noscript template".split())
HEAD = frozenset("title meta link base script style noscript template".split())
NEVER_NAMED = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promoted share sharing social comment comments "
    "disqus respond related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent "
    "notice banner newsletter subscribe subscription popup modal footer masthead toolbar pagination pager login signup "
    "search complementary contentinfo".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right box list area section wrapper container widget block inner outer bar item items links link "
    "primary secondary global header wrap group panel container content text js".split()
)
MARKS = ("article", "main")
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
# --- end of fixed values


def _is_side(name: str) -> bool:
    """Whether a class, id or role names what is no content."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    side = [x in NEVER_NAMED for x in parts]
    return any(side) and all(s or x in NEUTRAL for s, x in zip(side, parts, strict=True))


def _prior(name: str) -> float:
    if name == "a":
        return 1.0
    if name in INLINE or name in CONTENT or name == CUT:
        return 0.3
    return 5.0 if name in FRAME else 3.0


class Page:
    """The items of a page in order: ``(element, tag or None, names, text or None)``; a tag belongs to its own element."""

    def __init__(self, source: str):
        self.items: list[tuple[int, str | None, tuple[str, ...], str | None]] = []
        self.parent, self.never, self.mark, self.closed = [-1], [False], [False], [True]
        stack: list[tuple[str, int]] = [("", 0)]
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.items.append((stack[-1][1], None, (), source[at : m.start()]))
            at = m.end()
            name = m[3] or m[6]
            if not name:
                if m[1]:
                    self.items.append((stack[-1][1], CUT, (), None))
                continue
            name, end, rest = name.lower(), m[2] or m[5], m[4] or m[7] or ""
            if not end and name not in HEAD and name != "head" and any(n == "head" for n, _ in stack):
                k = next(k for k, (n, _) in enumerate(stack) if n == "head")  # a body begins
                self.closed[stack[k][1]] = True
                del stack[k:]
            if end:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                self.items.append((stack[k or -1][1], "/" + name, (), None))
                if k:
                    for _, e in stack[k:]:
                        self.closed[e] = True
                    del stack[k:]
                continue
            names = tuple(n for x in _NAMES.findall(rest) for n in x.strip("\"'").lower().split()) if rest else ()
            if name in CLOSES_ITSELF and stack[-1][0] == name:
                self.closed[stack.pop()[1]] = True
            if name in VOID or rest.endswith("/"):
                self.items.append((stack[-1][1], name, names, None))
                continue
            frame = name in ("html", "body", *MARKS)
            self.parent.append(stack[-1][1])
            in_head = name == "head" or (name in HEAD and stack[-1][0] == "head")
            self.never.append(
                name in NEVER or in_head or (name == "header" and not self._marked(stack)) or (not frame and any(map(_is_side, names)))
            )
            self.mark.append(name in MARKS or (bool(rest) and bool(_MARKED.search(rest))))
            self.closed.append(False)
            stack.append((name, len(self.parent) - 1))
            self.items.append((stack[-1][1], name, names, None))
        if at < len(source):
            self.items.append((stack[-1][1], None, (), source[at:]))
        self._settle()

    def _settle(self) -> None:
        """What is left out: side matter that is closed and holds neither the mark nor most of the words."""
        n = len(self.parent)
        words, holds = [0] * n, list(self.mark)
        for e, tag, _, text in self.items:
            if tag is None:
                words[e] += len(text.split())
        for e in range(n - 1, 0, -1):  # children come after their parents
            up = self.parent[e]
            words[up] += words[e]
            holds[up] = holds[up] or holds[e]
        for e in range(1, n):
            side = self.never[e] and self.closed[e] and not holds[e] and words[e] < MOST * max(1, words[0])
            self.never[e] = self.never[self.parent[e]] or side

    def _marked(self, stack: list[tuple[str, int]]) -> bool:
        return any(self.mark[e] for _, e in stack)

    def content(self) -> set[int] | None:
        """The elements in the page's one mark, or None if it has none, several or an open one."""
        roots = [e for e in range(1, len(self.parent)) if self.mark[e]]
        outer = [e for e in roots if self.parent[e] not in roots and not self._under(e, roots)]
        if len(outer) != 1 or not self.closed[outer[0]]:
            return None
        inside = {outer[0]}
        for e in range(outer[0] + 1, len(self.parent)):
            if self.parent[e] in inside:
                inside.add(e)
        return inside

    def scored(self) -> set[int]:
        """The elements that alone score: those in the page's one mark, if it holds enough words; else none is preferred."""
        inside = self.content()
        if inside is None:
            return set()
        words = [(e in inside, len(text.split())) for e, tag, _, text in self.items if tag is None and not self.never[e]]
        return inside if sum(n for i, n in words if i) >= TEASER * sum(n for _, n in words) else set()

    def _under(self, e: int, roots: list[int]) -> bool:
        while (e := self.parent[e]) > 0:
            if e in roots:
                return True
        return False


def counts(source: str) -> Counter:
    """``(tag or .name, inside the mark)`` of a page that labels itself; none of other pages."""
    page = Page(source)
    inside = page.content()
    found: Counter = Counter()
    if inside is not None:
        for e, tag, names, _ in page.items:
            if tag and tag != CUT and not page.never[e]:
                for key in (tag, *("." + n for n in names)):
                    found[key, page.parent[e] in inside] += 1  # the mark itself stands outside
    return found


class Weights:
    """What each tag costs, in words."""

    def __init__(self, learned: dict[str, tuple[int, int]] | None = None):
        """``learned``: occurrences inside and outside, by tag or ``.name``."""
        self.extra = {
            k: STEP * math.log((out + 1) / (into + 1))
            for k, (into, out) in (learned or {}).items()
            if out > into and (k[0] != "." or into + out >= LEAST)
        }
        self.known: dict[str, float] = {}

    def cost(self, tag: str, names: tuple[str, ...]) -> float:
        base = self.known.get(tag)
        if base is None:
            base = self.known[tag] = _prior(tag.lstrip("/")) + self.extra.get(tag, 0.0)
        return base + max((self.extra.get("." + n, 0.0) for n in names), default=0.0) if names else base


def main_text(source: str | None, weights: Weights) -> str:
    page = Page(source or "")
    best, best_from, best_to = 0.0, 0, 0
    total, start = 0.0, 0
    inside = page.scored()
    for i, (e, tag, names, text) in enumerate(page.items):
        if tag:
            total -= 0.0 if page.never[e] or e in inside else weights.cost(tag, names)
        elif not page.never[e]:
            total += len(text.split()) if not inside or e in inside else 0
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    out: list[str] = []
    for e, tag, _, text in page.items[best_from:best_to]:
        if text is not None:
            if not page.never[e]:
                out.append(html.unescape(text))
        elif tag.lstrip("/") not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def fit(pages: DataFrame, most: int = MOST_NAMES) -> Weights:
    """Weights from all ``pages(html)`` that label themselves, of the ``most`` frequent tags and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            columns = [[k for k, _ in found], [i for _, i in found], list(found.values())]
            kinds = (pa.string(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tag", "inside", "n"])

        found: Counter = Counter()
        for batch in batches:
            for source in batch.column("html").to_pylist():
                found.update(counts(source))
            if len(found) > HELD_NAMES:
                yield result()
                found.clear()
        yield result()

    counted = pages.select("html").where("html IS NOT NULL").mapInArrow(run, "tag string, inside boolean, n long")
    sides = [F.sum(F.when(F.col("inside") == side, F.col("n")).otherwise(0)).alias(name) for name, side in (("into", True), ("out", False))]
    names = counted.groupBy("tag").agg(*sides).where("into + out > 1")
    rows = names.orderBy(F.desc(F.col("into") + F.col("out")), "tag").limit(most).collect()
    return Weights({r["tag"]: (r["into"], r["out"]) for r in rows})


def extract(pages: DataFrame, weights: Weights, source: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each row's whole page."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(source)
        return [pa.array([main_text(column[i].as_py(), weights) for i in range(len(column))], pa.string())]

    return with_columns(pages, [T.StructField(into, T.StringType())], run)
