"""Main text of web pages by the best-scoring contiguous region (operator 9).

A page is a row of text runs and tags. Words count for a region and tags against it, by
weights learned from pages that mark their main text themselves; one scan finds the region
with the largest sum. Words of menus, forms, comments and the like count against it, too,
and are left out where the region spans them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, stored, table, text_slices

#: Names whose weights are sent to all tasks; if there are more, each page gets those of its own names by a join.
NAMES = 4096
#: Pages a name must occur on to have a learned weight.
LEAST_PAGES = 5

# Elements and names of parts that are not main text, elements that mark it,
# elements whose content is no markup, elements without content, and inline elements.
BOILERPLATE_TAGS = frozenset(
    "nav header footer aside form button select option label fieldset input textarea menu dialog head title noscript iframe object svg canvas "
    "audio video template".split()
)
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split()
)
# Words that only say where or what kind of box: a name of these and boilerplate words alone is boilerplate.
LAYOUT_NAMES = frozenset(
    "area bar block body bottom box center column container global inner item left line link links list main outer overlay page panel "
    "primary right secondary section site top wrap wrapper".split()
)
# Elements whose class names tell about the whole page.
WHOLE_PAGE = frozenset(("html", "body", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

# A tag ends at its ">", or at the next "<" outside of quoted values if it has none; every part is read once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
_SELF_CLOSING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))


class Element:
    """An open element: its own names, those that no element around it has, and what is known of the place."""

    __slots__ = ("tag", "names", "fresh", "parent", "by_tag", "by_name", "main", "words", "headed")

    def __init__(self, tag: str = "", attributes: str = "", parent: Element | None = None):
        self.tag, self.parent, self.names, self.fresh = tag, parent, [], []
        by_tag, by_name, main = tag in BOILERPLATE_TAGS, False, tag in MAIN_TAGS
        for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            words = "".join(values).lower().split()
            if kind.lower() == "role":
                by_tag, main = by_tag or bool(BOILERPLATE_ROLES.intersection(words)), main or words == ["main"]
            elif tag not in WHOLE_PAGE:
                by_name = by_name or any(map(_says_boilerplate, words))
                self.names += [f".{w}" for w in words]
        around = parent or _NOWHERE
        # A heading in the header of the main text belongs to the text.
        if tag in HEADINGS and around.tag == "header" and around.main and not around.by_name and not around.parent.bad:
            self.by_tag = False
        else:
            self.by_tag = around.by_tag or by_tag
        self.by_name = around.by_name or by_name
        self.main = around.main or (main and not self.bad)
        self.words, self.headed = 0, tag in HEADINGS

    @property
    def bad(self) -> bool:
        return self.by_tag or self.by_name


class _Nowhere:
    tag, by_tag, by_name, main = "", False, False, False


_NOWHERE = _Nowhere()


def _says_boilerplate(name: str) -> bool:
    """Whether a name is made of words for boilerplate, with words for places at most: not "no-sidebar"."""
    pieces = _WORD.findall(name)
    return any(p in BOILERPLATE_NAMES for p in pieces) and all(p in BOILERPLATE_NAMES or p in LAYOUT_NAMES or p.isdigit() for p in pieces)


def parts(html: str) -> Iterator[tuple[str, str, Element]]:
    """``(kind, value, element)`` in page order, in time that grows with the page's length.

    Kind is "text" or "tag"; a text comes with the element it stands in, a tag with its own or,
    when it closes one, with the innermost open element. Comments, declarations and the content
    of scripts and styles are left out.
    """
    stack = [Element()]
    tags_open: Counter = Counter()
    names_open: Counter = Counter()
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                yield "text", m[0], stack[-1]
            continue
        tag = tag.lower()

        def leave() -> str:
            gone = stack.pop()
            tags_open[gone.tag] -= 1
            names_open.subtract(gone.names)
            return gone.tag

        if m[1]:
            yield "tag", tag, stack[-1]
            if tags_open[tag]:
                while leave() != tag:
                    pass
            continue
        if tag in _SELF_CLOSING and stack[-1].tag == tag:
            leave()
        here = Element(tag, m[3], stack[-1])
        here.fresh = list({n for n in here.names if not names_open[n]})
        yield "tag", tag, here
        if tag in RAW:
            close = _CLOSE[tag].search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(here)
            tags_open[tag] += 1
            names_open.update(here.names)


def elements_of(rows: list[tuple[str, str, Element]]) -> list[Element]:
    """The elements of a page, each after the one around it, with all words they hold and whether a heading is among them."""
    found = list(dict.fromkeys(e for _, _, element in rows for e in (element.parent or element, element)))
    for kind, value, element in rows:
        if kind == "text":
            element.words += len(value.split())
    for element in reversed(found):
        if element.parent is not None:
            element.parent.words += element.words
            element.parent.headed |= element.headed
    return found


class Weights:
    """What a word counts by the names it stands under, and a tag by its name."""

    WORD, AGAINST, OUTSIDE, INNER, LEAST, TAG_LEAST = 1.0, -2.0, -1.0, -0.05, -3.0, -1.0

    def __init__(self, names: dict[str, float], tags: dict[str, float]):
        self.names, self.tags = names, tags

    def of_elements(self, elements: list[Element], marked: bool, wide: float) -> dict[Element, float]:
        """What a word counts directly in each element.

        Where main text is marked, the marks decide. Elsewhere the innermost element with a learned
        name does: the strongest evidence against among its names is added to the one a word counts.
        Names of elements with more than ``wide`` words and a heading say nothing.
        """
        evidence: dict[Element | None, tuple[float, bool]] = {None: (0.0, False)}
        worth = {}
        for e in elements:
            learned, by_name = evidence[e.parent]
            if e.words <= wide or not e.headed:
                own = [self.names[n] for n in e.names if n in self.names]
                learned = min(own) if own else learned
                by_name = by_name or (e.by_name and not (e.parent is not None and e.parent.by_name))
            evidence[e] = learned, by_name
            if e.main:
                worth[e] = self.INNER if e.bad else self.WORD
            elif e.by_tag or by_name:
                worth[e] = self.AGAINST
            elif marked:
                worth[e] = self.OUTSIDE
            else:
                worth[e] = max(self.AGAINST, self.WORD + min(learned, 0.0))
        return worth

    def tag(self, tag: str, main: bool) -> float:
        return -0.01 if main else self.tags.get(tag, -0.2)


def best_region(values: list[float]) -> tuple[int, int]:
    """First and last place of the stretch with the greatest positive sum, by one scan; (0, -1) without any."""
    best, best_from, best_to, total, since = 0.0, 0, -1, 0.0, 0
    for i, worth in enumerate(values):
        if total <= 0:
            total, since = 0.0, i
        total += worth
        if total > best:
            best, best_from, best_to = total, since, i
    return best_from, best_to


def row_values(rows: list[tuple[str, str, Element]], worth: dict[Element, float], weights: Weights) -> list[float]:
    return [weights.tag(value, e.main) if kind == "tag" else len(value.split()) * worth[e] for kind, value, e in rows]


def main_text(html: str | None, weights: Weights) -> str:
    """Text of the best region; empty without any.

    If no word counts, names around more than half of all words with a heading are taken
    for names of the page's frame, and the page is scored without them.
    """
    rows = list(parts(html or ""))
    elements = elements_of(rows)
    marked = any(e.main for e in elements)
    words = sum(len(value.split()) for kind, value, e in rows if kind == "text" and not e.by_tag)
    for wide in (float("inf"), words / 2):
        worth = weights.of_elements(elements, marked, wide)
        first, last = best_region(row_values(rows, worth, weights))
        if last >= first:
            break
    blocks: list[list[str]] = [[]]
    for kind, value, e in rows[first : last + 1]:
        if kind == "tag":
            if value not in INLINE:
                blocks.append([])
        elif worth[e] > 0:
            blocks[-1].append(value)
    return " ".join(t for b in blocks if (t := " ".join(unescape("".join(b)).split())))


def page_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(kind, name, pages, inside, outside)``: words under each name and tags, in and out of main text.

    Only pages that mark their main text teach; a word under boilerplate counts as outside
    wherever it stands. Words are counted under the classes and ids they stand in, since
    the elements' own names are too general to say anything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                seen: Counter = Counter()
                where: tuple[Counter, Counter] = Counter(), Counter()
                for html in texts.to_pylist():
                    rows = list(parts(html or ""))
                    elements = elements_of(rows)
                    if not any(e.main for e in elements):
                        continue
                    mine = {("tag", value) for kind, value, _ in rows if kind == "tag"}
                    inside: Counter = Counter()
                    for kind, value, e in rows:
                        if kind == "tag":
                            where[e.main and not e.bad]["tag", value] += 1
                        elif e.main and not e.bad:
                            inside[e] += len(value.split())
                    for e in reversed(elements):
                        inside[e.parent] += inside[e]
                        for n in e.fresh:
                            where[True]["word", n] += inside[e]
                            where[False]["word", n] += e.words - inside[e]
                            mine.add(("word", n))
                    seen.update(mine)
                keys = list(seen)
                columns = [[k for k, _ in keys], [n for _, n in keys], [seen[k] for k in keys], [where[1][k] for k in keys], [where[0][k] for k in keys]]
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "name", "pages", "inside", "outside"])

    counted = narrowed(pages, html=html_col).mapInArrow(run, "kind string, name string, pages bigint, inside bigint, outside bigint")
    return counted.groupBy("kind", "name").agg(F.sum("pages").alias("pages"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def _weights(counts) -> Weights:
    """Weights from rows (kind, name, inside, outside)."""
    odds: dict[str, dict[str, float]] = {"word": {}, "tag": {}}
    for r in counts:
        odds[r["kind"]][r["name"]] = float(np.clip(np.log((r["inside"] + 0.5) / (r["outside"] + 0.5)), Weights.LEAST, 1.0))
    return Weights(odds["word"], {t: float(np.clip(o, Weights.TAG_LEAST, -0.02)) for t, o in odds["tag"].items()})


def learned_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Counts of all names and tags that occur on enough of the pages that mark their main text."""
    return page_counts(pages, html_col).where(F.col("pages") >= LEAST_PAGES).select("kind", "name", "inside", "outside")


def learned_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all pages that mark their main text, of all names on the driver.

    A name or tag weighs the log of its odds to be inside, cut to a few units; tags never
    count in favour. Without such pages, words count one and tags a little against.
    """
    return _weights(learned_counts(pages, html_col).collect())


def learned_main_texts(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), names: int = NAMES) -> DataFrame:
    """``main_texts`` by weights learned from ``pages`` themselves, for any number of names.

    Up to ``names`` weights go to all tasks. More stay a table, which is joined to the names of
    each page; both ways give the same texts.
    """
    counts = stored(learned_counts(pages, html_col), "names")
    if counts.count() <= names:
        return main_texts(pages, _weights(counts.collect()), html_col, keep)
    html = F.col(f"`{html_col}`")
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(html).alias("__page__"), html.alias("__html__"))

    def names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                rows = [
                    (page, *key) for page, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts.to_pylist())
                    for key in {k for kind, value, e in parts(text or "") for k in (*([("tag", value)] if kind == "tag" else ()), *(("word", n) for n in e.fresh))}
                ]
                columns = zip(*rows) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["__page__", "kind", "name"])

    found = source.select("__page__", "__html__").mapInArrow(names_of, "__page__ bigint, kind string, name string").distinct().join(counts, ["kind", "name"])
    own = found.groupBy("__page__").agg(F.collect_list(F.struct("kind", "name", "inside", "outside")).alias("__counts__"))
    joined = source.join(own, "__page__", "left").select(*[F.col(f"`{c}`") for c in keep], "__counts__", "__html__")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(len(keep) + 1)):
                part = batch.slice(start, len(texts))
                texts_found = [main_text(h, _weights(c or ())) for h, c in zip(texts.to_pylist(), part.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts_found, pa.string())], [*keep, "text"])

    return joined.mapInArrow(run, f"{fields}, text string")


def main_texts(pages: DataFrame, weights: Weights, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text`` of every row; a null page has an empty text.

    Character references are decoded, white space inside a block becomes one space, and the
    blocks are joined by one space in page order. Repeated rows and null ids are rows like
    any other; extra columns are left out.
    """
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html__"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(len(keep))):
                found = pa.array([main_text(h, weights) for h in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns[:-1], found], [*keep, "text"])

    return source.mapInArrow(run, f"{fields}, text string")


@query("op9_html")
def op9_html(spark, folder):
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return learned_main_texts(pages).withColumn("n_chars", F.length("text").cast("bigint"))
