"""Cut fields, blocks, rows and links out of pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.schemas import FieldSpec, SourceSpec
from shelfspark.session import ship_package, spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# a start tag of the key ends open elements of the listed names, up to a fence
FENCES = frozenset(("table", "ul", "ol", "div", "article"))
ENDS = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STEP = re.compile(r"(>)|([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\]|:nth\(\d+\))*)")
PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]|:nth\((\d+)\)")
# pages whose markup and hits a task holds as Python objects
PAGES_AT_ONCE = 16

HREF = r"""(?i)(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


class _Step:
    """One step of a selector: what the element must be, and its parent link."""

    def __init__(self, tag: str, parts: str, child: bool):
        self.tag, self.child = tag, child
        self.tests = [(cls, key, attr, value.strip("\"'") if value else None, int(nth or 0))
                      for cls, key, attr, value, nth in PART.findall(parts)]

    def fits(self, node: "_Node") -> bool:
        if self.tag and self.tag != node.tag:
            return False
        for cls, key, attr, value, nth in self.tests:
            if cls and cls not in (node.attrs.get("class") or "").split():
                return False
            if key and node.attrs.get("id") != key:
                return False
            if attr and (attr not in node.attrs or (value is not None and node.attrs[attr] != value)):
                return False
            if nth and node.nth != nth:
                return False
        return True


class _Node:
    __slots__ = ("tag", "attrs", "nth", "children", "captures")

    def __init__(self, tag: str, attrs: dict, nth: int):
        self.tag, self.attrs, self.nth = tag, attrs, nth
        self.children: dict[str, int] = {}
        self.captures: list = []


def parse_selector(selector: str) -> list[_Step]:
    steps, child = [], False
    for word in selector.split():
        arrow, tag, parts = STEP.fullmatch(word).groups()
        if arrow:
            child = True
        else:
            steps.append(_Step(tag or "", parts or "", child))
            child = False
    return steps


def _selected(path: list[_Node], steps: list[_Step]) -> bool:
    """Does the innermost element of `path` match the selector? The first of the path is the page."""
    def back(at: int, step: int) -> bool:
        if not steps[step].fits(path[at]):
            return False
        if step == 0:
            return True
        if steps[step].child:
            return at > 1 and back(at - 1, step - 1)
        return any(back(up, step - 1) for up in range(at - 1, 0, -1))
    return back(len(path) - 1, len(steps) - 1)


class _Cutter(HTMLParser):
    """Collects the hits of all fields in one pass over a page."""

    def __init__(self, fields: list[tuple[str, str, list[_Step]]]):
        super().__init__(convert_charrefs=True)
        self.fields = fields

    def cut(self, html: str) -> dict[str, list[str]]:
        self.reset()
        self.source = html
        self.lines = [0] + [m.end() for m in re.finditer("\n", html)]
        self.hits: dict[str, list] = {name: [] for name, _, _ in self.fields}
        self.path = [_Node("", {}, 1)]
        # open elements by tag, and the open captures of whole texts, innermost last
        self.open: Counter[str] = Counter()
        self.texts: list[tuple[str, int]] = []
        self.feed(html)
        self.close()
        self._pop_to(1, len(html))
        return {name: [h if isinstance(h, str) else "".join(h) for h in found]
                for name, found in self.hits.items()}

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _pop_to(self, depth: int, at: int) -> None:
        while len(self.path) > depth:
            node = self.path.pop()
            self.open[node.tag] -= 1
            for kind, name, slot in node.captures:
                if kind == "html":
                    self.hits[name][slot] = self.source[self.hits[name][slot]:at]
                elif kind == "all_text":
                    self.texts.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS and any(self.open[t] for t in ENDS[tag]):
            ended, outer = None, FENCES | {"tr"} if tag in ("td", "th") else FENCES
            for depth in range(len(self.path) - 1, 0, -1):
                if self.path[depth].tag in ENDS[tag]:
                    ended = depth
                elif self.path[depth].tag in outer:
                    break
            if ended:
                self._pop_to(ended, self._here())
        parent = self.path[-1]
        parent.children[tag] = nth = parent.children.get(tag, 0) + 1
        node = _Node(tag, dict(attrs), nth)
        self.path.append(node)
        self.open[tag] += 1
        for name, take, steps in self.fields:
            if (not steps[-1].tag or steps[-1].tag == tag) and _selected(self.path, steps):
                if take.startswith("attr:"):
                    value = node.attrs.get(take[5:])
                    if value is not None:
                        self.hits[name].append(value)
                else:
                    node.captures.append((take, name, len(self.hits[name])))
                    if take == "all_text":
                        self.texts.append((name, len(self.hits[name])))
                        self.hits[name].append([])
                    elif take == "html":
                        self.hits[name].append(self._here())
        if tag in VOID:
            self._pop_to(len(self.path) - 1, self._here() + len(self.get_starttag_text()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].tag == tag:
                self._pop_to(depth + 1, self._here())
                close = self.source.find(">", self._here())
                self._pop_to(depth, len(self.source) if close < 0 else close + 1)
                return

    def handle_data(self, data: str) -> None:
        for kind, name, _ in self.path[-1].captures:
            if kind == "text":
                self.hits[name].append(data)
        for name, slot in self.texts:
            self.hits[name][slot].append(data)


def _cut_parts(batches: Iterator[pa.RecordBatch], plan: Sequence[tuple[str, str, str]], keep: Sequence[str], html: str,
               names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns and the hits of each page, a few pages at a time.

    Spark fills a batch with up to 10,000 pages; only the markup of one part of it becomes Python objects.
    """
    cutter = _Cutter([(name, take, parse_selector(sel)) for name, take, sel in plan])
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(at, PAGES_AT_ONCE)
            found = [cutter.cut(page or "") for page in part.column(html).to_pylist()]
            hits = [pa.array([cuts[name] for cuts in found], pa.list_(pa.string())) for name, _, _ in plan]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + hits, list(names))


def extract_fields(pages: DataFrame, fields: Sequence[FieldSpec], html: str = "html",
                   keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One `array<string>` column of hits per field, next to the kept columns.

    Selectors need a parser, so this is the one Python step of the ingest: it
    gets only the kept columns and the markup, in Arrow batches, and goes
    through each page once for all fields; a batch leaves in small parts.
    """
    ship_package(pages.sparkSession)
    plan = [(f.name, f.take, f.selector) for f in fields]
    keep = list(keep)
    schema = T.StructType(
        [pages.schema[c] for c in keep]
        + [T.StructField(name, T.ArrayType(T.StringType())) for name, _, _ in plan])

    names = schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_parts(batches, plan, keep, html, names)

    hits = spread(pages.select(*dict.fromkeys([*keep, html]))).mapInArrow(cut, schema)
    for f in fields:
        if f.column_fn is not None:
            hits = hits.withColumn(f.name, f.column_fn(F.col(f.name)))
    return hits


def site_fields(pages: DataFrame, spec: SourceSpec, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The fields of a site's pages; pages with one of its error markers are left out before they are parsed."""
    for marker in spec.lacking:
        pages = pages.filter(F.coalesce(lacking(marker), F.lit(True)))
    return extract_fields(pages, spec.fields, keep=keep)


def tag_text(html: Column, tag: str) -> Column:
    """Hits of a single tag without inner markup: the native form of a field."""
    return F.regexp_extract_all(html, F.lit(f"<{tag}(?:\\s[^>]*)?>([^<]*)</{tag}>"), F.lit(1))


def block(hits: Column, position: int) -> Column:
    """The n-th block (from 0), null when the page has fewer."""
    return F.get(hits, F.lit(position))


def table_rows(rows: DataFrame, row_html: str, cell_tag: str, keep: Sequence[str],
               header_rows: int = 1) -> DataFrame:
    """Table markup -> one row per table row with its cells as an array.

    `row_html` holds the markup of the page's rows, as cut with take `html`. Cells are the direct
    text nodes of the row's `cell_tag` elements: a cell with inner elements gives one for the
    text before each of them and after the last, and an empty cell none.
    """
    body = F.slice(F.col(row_html), header_rows + 1,
                   F.greatest(F.size(row_html) - header_rows, F.lit(0)))
    exploded = rows.select(*keep, F.posexplode(body).alias("row_no", "row"))
    return (extract_fields(exploded, [FieldSpec("cells", cell_tag)], html="row", keep=[*keep, "row_no", "row"])
            .select(*keep, "row_no", "row", "cells"))


def row_attribute(row: Column, name: str) -> Column:
    """First value of an attribute in a row's markup, null without one."""
    return F.nullif(F.regexp_extract(row, f'\\s{name}="([^"]*)"', 1), F.lit(""))


def decode_entities(value: Column) -> Column:
    """The entities that addresses hold; `&amp;` last, so nothing is decoded twice."""
    for name, text in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(text))
    return value


def page_links(html: Column) -> Column:
    """Every href on a page: in double, single or no quotes, in any case; not the end of another attribute's name."""
    quoted = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(quoted, lambda h: decode_entities(F.regexp_replace(h, "^[\"']|[\"']$", "")))


def extract_links(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per link, in page order."""
    return pages.select(*keep, F.posexplode(page_links(F.col("html"))).alias("link_no", "href"))


def containing(text: str, column: str = "html") -> Column:
    return F.col(column).contains(text)


def lacking(text: str, column: str = "html") -> Column:
    return ~F.col(column).contains(text)
