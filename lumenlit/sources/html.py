"""Structure of HTML pages by the standard library's parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.sections, self.links, self.skip, self.inside = "", [], 0, 0, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3"):
            self.sections.append([tag, "", ""])
            self.inside = tag
        elif tag == "title":
            self.inside = tag
        elif tag == "a" and dict(attrs).get("href"):
            self.links += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.inside:
            self.inside = ""

    def handle_data(self, data):
        if self.skip:
            return
        if self.inside == "title":
            self.title += data
        elif self.inside and self.sections:
            self.sections[-1][1] += data
        elif self.sections:
            self.sections[-1][2] += data + " "


def parse_page(html: str | None) -> dict:
    """title, number of links, and the sections (level, heading, text); broken
    markup gives what can be read."""
    p = _Page()
    p.feed(html or "")
    p.close()
    return {"title": p.title.strip(), "links": p.links, "sections": [{"level": a, "heading": b.strip(), "text": " ".join(c.split())} for a, b, c in p.sections]}


def parse_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    kind = "page_id long, title string, links int, sections array<struct<level:string,heading:string,text:string>>"
    schema = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("links", pa.int32()), ("sections", pa.list_(pa.struct([("level", pa.string()), ("heading", pa.string()), ("text", pa.string())])))])

    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_pylist([{"page_id": i, **parse_page(h)} for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, kind)
