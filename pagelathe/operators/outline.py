"""A page parsed once: its text as numbered pieces, its elements as intervals of pieces, and what it says of itself.

This is the only place where Python reads HTML. All that is made of a page (`content`, `metadata`) is expressions over the column that
`outlined` adds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags that a start tag closes if they are open: a paragraph ends at any block, an item at the next one.
ENDS = {t: {"p"} for t in BLOCKS - {"br", "body", "head", "html", "option", "caption", "tbody", "title", "summary"}} | {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
#: An end tag or an item's start does not reach beyond these.
FENCES = frozenset({"table", "ul", "ol", "dl", "select", "html", "body"})
#: Attributes that an outline keeps.
ATTRIBUTES = frozenset("class id role itemtype itemscope itemprop data-product data-testid aria-label name property content rel type href".split())
# The names of plain meta elements that are read; results must equal those of other readers.
META_NAMES = ("description", "author", "keywords", "news_keywords", "copyright", "publisher", "robots", "language", "pubdate", "date")


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    number: int
    begin: int  # its first piece
    up: int  # the number of its parent, -1 for none
    end: int = -1  # after its last piece
    last: int = -1  # the number of the last element inside it


@dataclass(eq=False)
class Outline(HTMLParser):
    """The outline of one page."""

    pieces: list[str] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)  # whether a block begins or ends before the piece
    elements: list[Element] = field(default_factory=list)
    open: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._break = True

    @staticmethod
    def of(html: str) -> Outline:
        page = Outline()
        page.feed(html)
        page.close()
        page._close(0)
        return page

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._break |= tag in BLOCKS
        if closes := ENDS.get(tag):
            for k in range(len(self.open) - 1, -1, -1):
                name = self.elements[self.open[k]].tag
                if name in closes:
                    self._close(k)
                elif name in FENCES:
                    break
        self.elements.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, len(self.elements), len(self.pieces), self.open[-1] if self.open else -1))
        if tag in VOID:
            self.elements[-1].end, self.elements[-1].last = len(self.pieces), len(self.elements) - 1
        else:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag: str) -> None:
        self._break |= tag in BLOCKS
        for k in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[k]].tag
            if name == tag:
                return self._close(k)
            if name in FENCES and tag not in FENCES:
                return None
        return None

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            e = self.elements[self.open.pop()]
            e.end, e.last = len(self.pieces), len(self.elements) - 1

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.fresh.append(self._break)
        self._break = False

    def text(self, e: Element) -> str:
        return " ".join(" ".join(self.pieces[e.begin : e.end]).split())


def flatten(value: object, prefix: str = "") -> dict[str, object]:
    """Dotted keys of nested JSON. In a list of objects the first has each key; a list of plain values stays a list."""
    out: dict[str, object] = {}
    if isinstance(value, dict):
        for k, v in value.items():
            out.update(flatten(v, f"{prefix}.{k}" if prefix else str(k)))
    elif isinstance(value, list):
        plain = [v for v in value if v is not None and not isinstance(v, (dict, list))]
        for v in value:
            if isinstance(v, (dict, list)):
                for k, x in flatten(v, prefix).items():
                    out.setdefault(k, x)
        if plain and prefix:
            out[prefix] = plain
    elif value is not None and prefix:
        out[prefix] = value
    return out


@dataclass(eq=False)
class Item:
    """An item of marked-up data: values by property, in order; a value may be an item."""

    kind: str
    values: dict[str, list] = field(default_factory=dict)

    def add(self, name: str, value: object) -> None:
        self.values.setdefault(name, []).append(value)

    def tree(self) -> dict[str, object]:
        out: dict[str, object] = {"@type": self.kind} if self.kind else {}
        for k, found in self.values.items():
            plain = [v.tree() if isinstance(v, Item) else v for v in found]
            out[k] = plain[0] if len(plain) == 1 else plain
        return out


def local_name(iri: str) -> str:
    """What stands after the last slash or hash of an address, or after the colon of a short form."""
    return iri.rstrip("/#").rpartition("/")[2].rpartition("#")[2].rpartition(":")[2]


#: Where the value of an element stands that is not its text.
VALUE_AT = {"a": "href", "area": "href", "link": "href", "object": "data", "data": "value", "meter": "value", "time": "datetime"} | dict.fromkeys(("audio", "embed", "iframe", "img", "source", "track", "video"), "src")


def value_of(page: Outline, e: Element, base: str) -> str:
    if e.attrs.get("content"):
        return e.attrs["content"]
    if (at := VALUE_AT.get(e.tag)) and e.attrs.get(at):
        return joined(base, e.attrs[at]) if at in ("href", "src", "data") else e.attrs[at]
    return page.text(e)


def joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def microdata(page: Outline, e: Element, base: str) -> tuple[str | None, list[tuple[str, str | None]]]:
    """The type, if e opens an item, and e's properties of the item around it, with values if e is none itself."""
    opens = local_name(e.attrs.get("itemtype", "").split(" ")[0]) if "itemscope" in e.attrs else None
    return opens, [(n, None if opens is not None else value_of(page, e, base)) for n in e.attrs.get("itemprop", "").split()]


def rdfa(page: Outline, e: Element, base: str) -> tuple[str | None, list[tuple[str, str | None]]]:
    opens = local_name(e.attrs["typeof"].split(" ")[0]) if e.attrs.get("typeof") else None
    names = [local_name(n) for n in e.attrs.get("property", "").split() if not n.startswith(("og:", "fb:", "article:", "twitter:", "product:"))]
    if opens is not None or not names:
        return opens, [(n, None) for n in names]
    resource = e.attrs.get("resource") if not e.attrs.get("content") else None
    return None, [(n, joined(base, resource) if resource else value_of(page, e, base)) for n in names]


#: Where a plain property of a microformat has its value, by tag.
PLAIN_AT = {"img": "alt", "area": "alt", "abbr": "title", "data": "value", "input": "value"}


def microformat(page: Outline, e: Element, base: str) -> tuple[str | None, list[tuple[str, str | None]]]:
    words = e.attrs.get("class", "").split()
    opens = next((w for w in words if w.startswith("h-") and len(w) > 2), None)
    link = e.attrs.get("href") or e.attrs.get("src") or e.attrs.get("data")
    special = {"u": joined(base, link) if link else None, "dt": e.attrs.get("datetime"), "p": e.attrs.get(PLAIN_AT.get(e.tag, "")), "e": None}
    found = [(name, kind) for kind, _, name in (w.partition("-") for w in words) if name and kind in special]
    return opens, [(name, None if opens else special[kind] or page.text(e)) for name, kind in found]


def items_of(page: Outline, read, base: str) -> list[Item]:
    """Items that lie in no other, in order: an element belongs to the item of its nearest ancestor that opens one."""
    top: list[Item] = []
    within: list[Item | None] = []  # by element, the item that its children belong to
    for e in page.elements:
        outer = within[e.up] if e.up >= 0 else None
        opens, values = read(page, e, base)
        inner = outer if opens is None else Item(opens)
        if opens is not None and (not values or outer is None):
            top.append(inner)
        elif outer is not None:
            for name, value in values:
                if opens is not None or value:
                    outer.add(name, inner if opens is not None else value)
        within.append(inner)
    return top


SYNTAXES = {"microdata": (microdata, "itemscope", None), "microformat": (microformat, "class", "h-"), "rdfa": (rdfa, "typeof", None)}


def facts_of(page: Outline, base: str = "") -> list[tuple[str, int, str, str]]:
    """(source, item, key, value) of all that a page says of itself; items of a source numbered from 0."""
    found: list[tuple[str, int, str, str]] = []
    number = 0
    for e in page.elements:
        a = e.attrs
        if e.tag == "html" and a.get("lang"):
            found.append(("meta", 0, "html.lang", a["lang"]))
        elif e.tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            for node in linked_data("".join(page.pieces[e.begin : e.end])):
                found += [("json-ld", number, k, written(v)) for k, v in flatten(node).items()]
                number += 1
        elif e.tag == "meta" and "content" in a:
            name = (a.get("name") or a.get("property") or "").strip()
            low = name.lower()
            if name.startswith("og:"):
                found.append(("opengraph", 0, name, a["content"]))
            if low.startswith(("twitter:", "og:", "article:")):
                found.append(("card", 0, low, a["content"]))
            elif a.get("name", "").strip().lower() in META_NAMES:
                found.append(("meta", 0, f"meta.{a['name'].strip().lower()}", a["content"]))
            if a.get("http-equiv", "").strip().lower() == "content-language":
                found.append(("meta", 0, "header.content-language", a["content"]))
        elif e.tag == "link" and "json+oembed" in a.get("type", "").lower() and "alternate" in a.get("rel", "").lower().split() and a.get("href"):
            found.append(("link", 0, "oembed", joined(base, a["href"])))
    for source, (read, mark, part) in SYNTAXES.items():
        if any(mark in e.attrs and (part is None or part in e.attrs[mark]) for e in page.elements):
            for i, item in enumerate(items_of(page, read, base)):
                found += [(source, i, k, written(v)) for k, v in flatten(item.tree()).items()]
    return found


def linked_data(script: str) -> Iterator[dict]:
    """The objects of a JSON-LD script, each followed by those of its @graph."""
    try:
        data = json.loads(script)
    except (ValueError, RecursionError):
        return
    for x in data if isinstance(data, list) else [data]:
        if isinstance(x, dict):
            graph = x.get("@graph")
            yield {k: v for k, v in x.items() if k != "@graph" or not isinstance(v, list)}
            yield from (y for y in (graph if isinstance(graph, list) else ()) if isinstance(y, dict))


def written(value: object) -> str:
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()  # JSON may name lone surrogates


PAGE = (
    "struct<pieces:array<struct<text:string,fresh:boolean>>,"
    "elements:array<struct<number:int,tag:string,attrs:map<string,string>,classes:array<string>,begin:int,stop:int,up:int,last:int>>,"
    "facts:array<struct<source:string,item:int,key:string,value:string>>>"
)


def _flat(rows: list[list[tuple]], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """Lists of tuples as a list array of structs."""
    offsets = pa.array([0, *_running(len(r) for r in rows)], pa.int32())
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [[]] * len(kinds)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names))


def _running(sizes) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def outlines(htmls: list[str | None], urls: list[str | None]) -> pa.Array:
    """The outline column of some pages; null html is an empty page."""
    pieces, elements, facts = [], [], []
    for html, url in zip(htmls, urls, strict=True):
        page = Outline.of(html or "")
        pieces.append(list(zip(page.pieces, page.fresh, strict=True)))
        elements.append([(e.number, e.tag, [(k, v) for k, v in e.attrs.items() if k in ATTRIBUTES], e.attrs.get("class", "").split(), e.begin, e.end, e.up, e.last) for e in page.elements])
        facts.append(facts_of(page, url or ""))
    s, i = pa.string(), pa.int32()
    parts = [
        _flat(pieces, ["text", "fresh"], [s, pa.bool_()]),
        _flat(elements, ["number", "tag", "attrs", "classes", "begin", "stop", "up", "last"], [i, s, pa.map_(s, s), pa.list_(s), i, i, i, i]),
        _flat(facts, ["source", "item", "key", "value"], [s, i, s, s]),
    ]
    return pa.StructArray.from_arrays(parts, names=["pieces", "elements", "facts"])


def outlined(pages: DataFrame, html: str = "html", url: str = "url", skip: str | None = None) -> DataFrame:
    """pages without `html`, with `page`: the outline and facts of each page (PAGE), parsed once.

    Null html is an empty page. Where the boolean column `skip` is true the page is not parsed and `page` is empty as well.
    A column `page` that is there already is replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, "page")]
    source = F.col(html) if skip is None else F.when(~F.coalesce(F.col(skip), F.lit(False)), F.col(html))
    address = F.col(url) if url in pages.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                made = outlines(own.column("__html").to_pylist(), own.column("__url").to_pylist())
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in kept), made], names=[*(f.name for f in kept), "page"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = pages.select(*[F.col(f"`{f.name}`") for f in kept], source.cast("string").alias("__html"), address.cast("string").alias("__url"))
    return rows.mapInArrow(run, f"{schema}, page {PAGE}" if kept else f"page {PAGE}")
