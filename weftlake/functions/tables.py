"""Table functions for SQL: a page's chunks, tables and links and a feed's items, as rows beside those of the query (LATERAL)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import dom

#: A heading's mark, wherever it stands; one that begins with a letter is searched for faster than one with a look behind.
_HEADING, _LINE_ENDS = re.compile("##{0,5}[" + dom.SPACE + "]"), "\n\r\u2028\u2029"
_ITEM = re.compile(r"<(?:item|entry).*?</(?:item|entry)>", re.I | re.S)
_CDATA, _MARK = re.compile(r"<!\[CDATA\[|\]\]>"), re.compile("<[^>]+>")
_HREF = re.compile(r"""<link[^>]*href=["']([^"']+)["']""", re.I)
_DATES = ("pubDate", "published", "updated", "dc:date")


def sections(markdown: str) -> list[str]:
    """As operators.chunk.sections."""
    cuts = [m.start() for m in _HEADING.finditer(markdown) if not m.start() or markdown[m.start() - 1] in _LINE_ENDS]
    return [x for x in (markdown[a:b] for a, b in zip([0, *cuts], [*cuts, len(markdown)], strict=True)) if x.strip(dom.SPACE)]


def items(xml: str, per_feed: int):
    """As sources.feeds.feed_items, for one feed: (ord, title, url, date)."""
    def tag(block: str, name: str) -> str:
        m = re.search(rf"<{name}[^>]*>(.*?)</{name}>", block, re.I | re.S)
        return _MARK.sub("", _CDATA.sub("", m[1])).strip(dom.SPACE) if m else ""

    n = 0
    for block in _ITEM.findall(xml):
        m = _HREF.search(block)
        title, url = tag(block, "title"), _CDATA.sub("", m[1] if m else tag(block, "link")).strip(" ")
        if n < per_feed and title and url.startswith("http"):
            yield n, title, url, next((d for d in (tag(block, t) for t in _DATES) if d), None)
            n += 1


class Chunks:
    """page_chunks(markdown, max_tokens, overlap): the chunks of a text. A null or empty one has none; null sizes are 512 tokens and no overlap."""

    def eval(self, markdown: str, max_tokens: int, overlap: int):
        from ..operators.chunk import pack_sections

        text = markdown or ""
        for c in pack_sections(sections(text), text, max_tokens if max_tokens is not None else 512, overlap or 0):
            yield c["index"], c["content"], c["tokens"], c["start_offset"], c["end_offset"]


class Tables:
    """page_tables(html): a row a table row, with the table's place and headers."""

    def eval(self, html: str):
        for i, t in enumerate(dom.tables(dom.parse(html or ""))):
            for k, cells in enumerate(t["rows"]):
                yield i, k, t["headers"], cells


class Links:
    """page_links(html, base): the page's links, each url once."""

    def eval(self, html: str, base: str):
        yield from dom.links(dom.parse(html or ""), base or "")


class FeedItems:
    """feed_entries(xml, per_feed): a feed's first items that have a title and an http url; null: 12 of them."""

    def eval(self, xml: str, per_feed: int):
        yield from items(xml or "", per_feed if per_feed is not None else 12)


#: What SQL calls each, and the rows that it gives.
FUNCTIONS = {
    "page_chunks": (Chunks, "index int, content string, tokens int, start_offset int, end_offset int"),
    "page_tables": (Tables, "table_index int, row_index int, headers array<string>, cells array<string>"),
    "page_links": (Links, "link string, text string, rel string, is_internal boolean"),
    "feed_entries": (FeedItems, "ord int, title string, link string, date string"),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL, under the names of FUNCTIONS. Rows are pickled in batches: by Arrow each call's rows would be a batch of their own."""
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema, useArrow=False))
