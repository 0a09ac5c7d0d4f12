"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags negative;
all weights are learnt from labelled pages, those that mark their article themselves
(`article` or `main`). The mark is the label and nothing else: neither tag is a feature,
and both are read over at prediction.

* A tag weighs the more the more often it stands outside of articles.
* A word weighs 1 plus a quarter of its log odds of standing in an article, if it is common
  enough, within `word_range`.
* An element's kinds are the tokens of its class, id and role (and their parts; numbers
  count alike), or its name if it has none. Text outside of an article counts against the
  outermost element around it that does not hold the article, text within for all elements
  around it. Where a kind's words are mostly outside, all its text is: it scores negative.

One linear scan finds the contiguous region of the highest sum. The scan may jump over
an element of an outside kind at a cost of at most `largest_jump`, so an advert between
two paragraphs costs no more than a few words; what it jumps over is left out. The text of
forms is never read, as the task has it.

Character references are decoded once, white space in a block becomes one space, blocks
are trimmed and joined in page order by a blank line. Nothing else is dropped or cut.

Bounds: about `sample` distinct pages are read for the weights. What is learnt from them
follows their vocabulary: kinds, tags and words seen `least_seen` times or more. Every page is
read whole, however long, in time linear in its length.
Defined cases: null, empty or wordless pages give an empty text; unclosed tags,
comments and truncated pages are read as far as they go; of regions with equal sums the
first; without a labelled page all tags weigh alike and no kind is outside; repeated rows
repeat, and count once in the sample; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.session import ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noscript|template|svg|xmp)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"  # a quote opens a value only after =
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Fixed values of HTML: elements without text of the page, forms, blocks, and elements without an end.
_NO_TEXT = frozenset("head form button select option datalist object canvas audio video map".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = ("article", "main")
_MARKED = re.compile(r"<(?:article|main)\b", re.I)


@dataclass(frozen=True)
class HtmlConfig:
    sample: int = 2000
    least_seen: int = 5
    unseen_tag: float = -0.5
    largest: float = -2.0
    least: float = -0.05
    outside: float = -1.0  # log odds from which on a kind is outside
    other_word: float = -0.4
    largest_jump: float = 3.0
    word_range: tuple[float, float] = (0.25, 2.0)


@dataclass
class Element:
    parent: int
    kinds: tuple[str, ...]
    main: bool  # marked as the article, or within one that is
    no_text: bool
    holds_main: bool = False


@dataclass
class Item:
    """A tag, or a stretch of text between tags."""

    tag: str = ""
    text: str = ""
    element: int = 0
    block: int = 0


def kinds(name: str, attrs: str) -> tuple[str, ...]:
    found: dict[str, None] = {}
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if key.lower() in ("class", "id", "role"):
            for token in re.sub(r"\d+", "#", (a or b or c).lower()).split():
                found["." + token] = None
                parts = [p for p in re.split(r"[-_#]+", token) if p]
                if parts != [token]:
                    found.update(("." + p, None) for p in parts)
    return tuple(found) or (name,)


def read(page: str) -> tuple[list[Item], list[Element]]:
    """The items of a page and its elements, parents first; element 0 is the page itself."""
    out: list[Item] = []
    elements = [Element(-1, (), False, False)]
    stack: list[tuple[str, int]] = [("", 0)]
    block, at = 0, 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(Item(text=page[at : m.start()], element=stack[-1][1], block=block))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in _BLOCK:
            block += 1
        if m["end"]:
            out.append(Item(tag=name, element=stack[-1][1], block=block))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _BLOCK and stack[-1][0] == "p":
            stack.pop()
        above = stack[-1][1]
        mark = name in _MAIN
        if mark:
            k = above
            while k >= 0 and not elements[k].holds_main:
                elements[k].holds_main = True
                k = elements[k].parent
        void = name in _VOID
        if void:
            element = above
        else:
            top = elements[above]
            of = () if mark or name in ("html", "body") else kinds(name, m["attrs"])
            elements.append(Element(above, of, top.main or mark, top.no_text or name in _NO_TEXT))
            element = len(elements) - 1
        out.append(Item(tag=name, element=element, block=block))
        if not void and not m["attrs"].endswith("/"):
            stack.append((name, element))
    if at < len(page):
        out.append(Item(text=page[at:], element=stack[-1][1], block=block))
    return out, elements


def page_counts(page: str) -> tuple[Counter, Counter]:
    """Of a page that marks its article: tags, kinds of elements (by words) and words within and outside of it, as (sort, name)."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    found, elements = read(page)
    blame = [-1] * len(elements)  # the outermost element around, itself included, that does not hold the article
    around: list[tuple[str, ...]] = [()] * len(elements)  # of the article's elements: the kinds around
    for k, e in enumerate(elements[1:], 1):
        if e.main:
            around[k] = tuple(dict.fromkeys(around[e.parent] + e.kinds)) if e.kinds else around[e.parent]
        elif not e.holds_main:
            blame[k] = blame[e.parent] if blame[e.parent] >= 0 else k
    for x in found:
        e = elements[x.element]
        if e.no_text or x.tag in _MAIN:
            continue
        if x.tag:
            if e.main:
                inside["tag", x.tag] += 1
            elif blame[x.element] in (-1, x.element):
                outside["tag", x.tag] += 1
            continue
        words = x.text.lower().split()
        side = inside if e.main else outside
        for kind in around[x.element] if e.main else elements[blame[x.element]].kinds if blame[x.element] >= 0 else ():
            side["kind", kind] += len(words)
        side.update(zip(repeat("word"), words))
    return inside, outside


@dataclass
class HtmlModel:
    tags: dict[str, float] = field(default_factory=dict)
    out: frozenset[str] = frozenset()  # kinds
    words: dict[str, float] = field(default_factory=dict)
    cfg: HtmlConfig = HtmlConfig()

    def roots(self, elements: list[Element]) -> list[int]:
        """The outermost element of an outside kind around each, itself included, or -1."""
        of = [-1] * len(elements)
        for k, e in enumerate(elements):
            above = of[e.parent] if e.parent >= 0 else -1
            of[k] = above if above >= 0 else k if not self.out.isdisjoint(e.kinds) else -1
        return of

    def scores(self, found: list[Item], elements: list[Element], roots: list[int]) -> list[float]:
        """The score of each item."""
        cfg, out, spent = self.cfg, [0.0] * len(found), {}
        for k, x in enumerate(found):
            root = roots[x.element]
            if elements[x.element].no_text or x.tag in _MAIN:
                continue
            if x.tag:
                out[k] = self.tags.get(x.tag, cfg.unseen_tag) if root < 0 else 0.0
            elif root < 0:
                out[k] = sum(map(self.words.get, x.text.lower().split(), repeat(1.0)))
            else:
                had = spent.get(root, 0.0)
                spent[root] = min(cfg.largest_jump, had - cfg.other_word * len(x.text.split()))
                out[k] = had - spent[root]
        return out

    @staticmethod
    def region(scores: list[float], jumped: list[bool]) -> list[tuple[int, int]]:
        """The stretches of places of the first region of the highest sum, between those that the scan jumps over."""
        best = run = 0.0
        first, lo, hi = 0, 0, 0
        for k, score in enumerate(scores):
            run += score
            if run <= 0:
                run, first = 0.0, k + 1
            elif run > best:
                best, lo, hi = run, first, k + 1
        out = []
        for k in range(lo, hi + 1):
            if k == hi or jumped[k]:
                if lo < k:
                    out.append((lo, k))
                lo = k + 1
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        found, elements = read(page)
        roots = self.roots(elements)
        blocks: dict[int, list[str]] = {}
        for lo, hi in self.region(self.scores(found, elements, roots), [roots[x.element] >= 0 for x in found]):
            for x in found[lo:hi]:
                if x.tag == "br":
                    blocks.setdefault(x.block, []).append(" ")
                elif not x.tag and not elements[x.element].no_text:
                    blocks.setdefault(x.block, []).append(x.text)
        joined = (" ".join(_html.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n\n".join(t for t in joined if t)


def weigh(inside: Counter, outside: Counter, cfg: HtmlConfig = HtmlConfig()) -> HtmlModel:
    """Weights from how often each tag, kind and word stands within and outside of articles."""
    seen = {k for k in inside | outside if inside[k] + outside[k] >= cfg.least_seen}
    total = [sum(n for (sort, _), n in side.items() if sort == "word") + 1 for side in (inside, outside)]
    odds = lambda k, scale=1.0: math.log((inside[k] + 1) / (outside[k] + 1) * scale)
    low, high = cfg.word_range
    return HtmlModel(
        {k[1]: max(cfg.largest, min(cfg.least, odds(k))) for k in seen if k[0] == "tag"},
        frozenset(k[1] for k in seen if k[0] == "kind" and odds(k) <= cfg.outside),
        {k[1]: max(low, min(high, 1 + odds(k, total[1] / total[0]) / 4)) for k in seen if k[0] == "word"},
        cfg,
    )


def counts(pages: list[str | None]) -> tuple[Counter, Counter]:
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page in pages:
        if page and _MARKED.search(page):
            i, o = page_counts(page)
            inside.update(i)
            outside.update(o)
    return inside, outside


def fit_pages(pages: list[str | None], cfg: HtmlConfig = HtmlConfig()) -> HtmlModel:
    return weigh(*counts(pages), cfg)


def fit(pages: DataFrame, cfg: HtmlConfig = HtmlConfig()) -> HtmlModel:
    """Weights from the labelled ones of about `sample` pages, chosen by a hash of the id. Only sums of counts come to the driver."""
    whole = pages.count()
    h = F.xxhash64("page_id", "url")
    if whole > cfg.sample:
        pages = pages.where(h < int(-(2**63) + cfg.sample / whole * 2**64))
    once = pages.groupBy("page_id", "url").agg(F.min(F.col("html").cast("string")).alias("html"))  # rows may repeat

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = counts(batch.column(0).to_pylist())
            keys = list(inside | outside)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [inside[k] for k in keys], [outside[k] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["sort", "name", "inside", "outside"])

    found = once.select("html").mapInArrow(count, "sort string, name string, inside long, outside long")
    sums = found.groupBy("sort", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = sums.where(F.col("inside") + F.col("outside") >= cfg.least_seen).collect()
    inside = Counter({(r["sort"], r["name"]): r["inside"] for r in rows})
    outside = Counter({(r["sort"], r["name"]): r["outside"] for r in rows})
    return weigh(inside, outside, cfg)


def main_text(pages: DataFrame, model: HtmlModel) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ship(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit(pages))
