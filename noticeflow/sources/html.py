"""Rows from web pages: the one stage that runs Python workers.

Pages are tag soup, which XML functions refuse, so ``mapInArrow`` with the standard library's parser turns a
table (page_id, html) into rows of raw texts and links; all that follows is built-in expressions.
Select just these two columns into it, and repartition first if few large files would give few tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from noticeflow.functions.text import strip

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag ends, if it is open within the named container.
_ENDS = {
    "p": ({"p"}, {"div", "td", "li", "article", "section", "body"}), "li": ({"li", "p"}, {"ul", "ol"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "p"}, {"table", "tbody", "thead", "tfoot"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "div": ({"p"}, {"div", "td", "li", "article", "section", "body"}), "ul": ({"p"}, {"div", "li", "td"}), "h2": ({"p"}, {"div"}), "h3": ({"p"}, {"div"}),
}


class Node:
    __slots__ = ("tag", "attrs", "parts", "no")

    def __init__(self, tag: str, attrs: dict[str, str], no: int):
        self.tag, self.attrs, self.parts, self.no = tag, attrs, [], no

    def walk(self) -> Iterator[Node | str]:
        """All nodes and pieces of text inside, in page order; however deep, with a stack of its own."""
        left = list(reversed(self.parts))
        while left:
            p = left.pop()
            yield p
            if isinstance(p, Node):
                left.extend(reversed(p.parts))

    def text(self) -> str:
        return "".join(p for p in self.walk() if isinstance(p, str))

    def packed(self) -> str:
        """Each piece stripped, joined without anything between."""
        return "".join(p.strip() for p in self.walk() if isinstance(p, str))

    def within(self) -> Iterator[Node]:
        return (p for p in self.walk() if isinstance(p, Node))

    def all(self, tag: str, css: str | None = None) -> list[Node]:
        return [n for n in self.within() if n.tag == tag and (css is None or css in n.attrs.get("class", "").split())]

    def first(self, tag: str, css: str | None = None) -> Node | None:
        return next(iter(self.all(tag, css)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, 0)
        self.open = [self.root]
        self.count = 0

    def handle_starttag(self, tag, attrs):
        ends, stops = _ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stops:
                break
            if self.open[k].tag in ends:
                del self.open[k:]
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.count)
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].parts.append(data)


def tree(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


#: A worker puts rows out once it has so many, or has read so many characters for them: so its memory does not depend on how many pages it gets.
ROWS, CHARS = 4096, 1 << 22


def _rows(batches: Iterator[pa.RecordBatch], read: Callable[[Node], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        out, size = [], 0
        for page, html in zip(batch.column(0), batch.column(1), strict=True):
            text = html.as_py()
            size += len(text or "")
            for row in read(tree(text)):
                out.append((page.as_py(), *row))
                if len(out) >= ROWS:
                    yield packed(out)
                    out, size = [], 0
            if out and size > CHARS:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)


def _extract(pages: DataFrame, read: Callable[[Node], list[tuple]], schema: str) -> DataFrame:
    whole = f"page_id long, {schema}"
    kinds = to_arrow_schema(T.StructType.fromDDL(whole))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(partial(_rows, read=read, schema=kinds), whole)


def _table_rows(root: Node) -> list[tuple]:
    out = []
    for table in root.all("table"):
        bodies = table.all("tbody") or [table]
        for row in (r for b in bodies for r in b.all("tr")):
            cells = [p for p in row.parts if isinstance(p, Node) and p.tag == "td"]
            links = [next((a.attrs.get("href") for a in c.all("a") if "href" in a.attrs), None) for c in cells]
            out.append((len(out), [c.text() for c in cells], links))
    return out


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_no, cells, links) of each row of each table body; links has each cell's first link."""
    return _extract(pages, _table_rows, "row_no int, cells array<string>, links array<string>")


def notices_from_tables(pages: DataFrame, source: str, least_cells: int = 5) -> DataFrame:
    """Notice rows of five-cell tables: publication, effective, (skipped), citation, title, and perhaps a link in the sixth."""
    cell = lambda k: strip(F.get("cells", k))
    return table_rows(pages).where(F.size("cells") >= least_cells).select(
        "page_id", "row_no", F.lit(source).alias("source"), cell(0).alias("publication_date"), cell(1).alias("effective_date"),
        cell(3).alias("citation"), cell(4).alias("title"), F.get("links", 5).alias("url"),
    )


@dataclass(frozen=True)
class Items:
    """Where a list of items lies in a page, each as (tag, class or None)."""

    block: tuple[str, str | None]
    title: tuple[str, str | None]
    date: tuple[str, str | None] = ("time", None)
    link_in_title: bool = True  # else the block's first link
    title_is_link: bool = False  # the title is the text of the block's first link, null without one
    packed: bool = False  # pieces of text stripped and joined, else as they are
    sections: tuple[str, ...] = ()  # headings whose next div holds the blocks; none: anywhere in the page
    heading: str = "h2"


# Where items lie in the layouts known so far.
NEWS_BY_LINK = Items(("div", "catItemView"), ("a", None), ("dd", "published"), title_is_link=True)
NEWS_BY_HEADING = Items(("div", "catItemView"), ("h3", "catItemTitle"), ("dd", "published"))
SECTIONED = Items(("div", "views-row"), ("h3", None), ("div", "views-field-created"), packed=True, sections=("Recent News", "Industry Notices"))
LISTED = Items(("li", "document-wrapper"), ("h5", None), ("time", None), packed=True)


def _next(root: Node, after: Node, tag: str) -> Node | None:
    return next((n for n in root.within() if n.no > after.no and n.tag == tag), None)


def _items(root: Node, spec: Items) -> list[tuple]:
    text = (lambda n: n.packed()) if spec.packed else (lambda n: n.text().strip())
    scopes: list[tuple[str | None, Node | None]] = [(None, root)]
    if spec.sections:
        scopes = []
        for name in spec.sections:
            head = next((h for h in root.all(spec.heading) if name in h.text()), None)
            scopes.append((name, head and _next(root, head, "div")))
    out = []
    for name, scope in scopes:
        for block in scope.all(*spec.block) if scope else []:
            link = block.first("a")
            title = link if spec.title_is_link else block.first(*spec.title)
            if title is None and not spec.title_is_link:
                continue  # an item without its title element is none
            if spec.link_in_title and not spec.title_is_link:
                link = title.first("a")
            date = block.first(*spec.date)
            links = [a.attrs["href"] for a in block.all("a") if a.attrs.get("href")]
            out.append((name, len(out), text(title) if title else None, link.attrs.get("href") if link else None, text(date) if date else None, links))
    return out


def items(pages: DataFrame, spec: Items) -> DataFrame:
    """(page_id, section, item_no, title, href, date_text, links) of each item; href and date_text are null where there is none."""
    return _extract(pages, partial(_items, spec=spec), "section string, item_no int, title string, href string, date_text string, links array<string>")


def first_pdf_link(links) -> F.Column:
    return F.get(F.filter(links, lambda x: F.endswith(x, F.lit(".pdf"))), 0)


def _paragraph_links(root: Node, container: tuple[str, str | None]) -> list[tuple]:
    box = root.first(*container)
    out = []
    for p_no, p in enumerate(box.all("p") if box else []):
        for a_no, a in enumerate(p.all("a")):
            out.append((p_no, a_no, p.packed(), a.attrs.get("href"), a.packed()))
    return out


def paragraph_links(pages: DataFrame, container: tuple[str, str | None] = ("div", "blog")) -> DataFrame:
    """(page_id, p_no, a_no, p_text, href, link_text) of each link in a paragraph of the page's first such container."""
    return _extract(pages, partial(_paragraph_links, container=container), "p_no int, a_no int, p_text string, href string, link_text string")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, href, link_text) of plain anchors, by built-in expressions alone."""
    pattern = '<a href="([^"]*)">([^<]*)</a>'
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))  # whole anchors: the page is searched once
    part = lambda k: F.regexp_extract("anchor", pattern, k)
    anchors = pages.select("page_id", F.posexplode(found).alias("link_no", "anchor"))
    return anchors.select("page_id", "link_no", part(1).alias("href"), part(2).alias("link_text"))
