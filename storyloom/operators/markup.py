"""HTML by an allow-list: a tokenizer that keeps some tags with some attributes, and the text of all others."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storyloom.sources.batches import slices

# What may stay, and what goes with all that is in it.
TAGS = frozenset(("b", "i", "em", "strong", "a", "span", "p", "br", "code", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote"))
ATTRIBUTES = frozenset(("href", "title", "target", "rel", "class", "id"))
DROPPED = frozenset(("script", "style", "svg", "iframe"))
BAD_SCHEMES = ("javascript:", "vbscript:", "data:")


class _Cleaner(HTMLParser):
    def __init__(self, tags: frozenset, attributes: frozenset):
        super().__init__(convert_charrefs=False)
        self.tags, self.attributes = tags, attributes
        self.out: list[str] = []
        self.open: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.inside or tag in DROPPED:
            if tag in DROPPED:
                self.inside.append(tag)
            return
        if tag not in self.tags:
            return
        kept = {}
        for name, value in attrs:
            value = value or ""
            plain = re.sub(r"[\x00-\x20]", "", value).lower()
            if name in self.attributes and name not in kept and not (name == "href" and plain.startswith(BAD_SCHEMES)):
                kept[name] = value
        self.out.append(f"<{tag}" + "".join(f' {k}="{html.escape(v)}"' for k, v in kept.items()) + ">")
        if tag != "br":
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.inside:
            if tag in self.inside:
                while self.inside.pop() != tag:
                    pass
        elif tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def _said(self, text: str) -> None:
        if not self.inside:
            self.out.append(text)

    def handle_data(self, data: str) -> None:
        self._said(data.replace("<", "&lt;").replace(">", "&gt;"))

    def handle_entityref(self, name: str) -> None:
        self._said(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._said(f"&#{name};")

    def result(self) -> str:
        return "".join(self.out) + "".join(f"</{tag}>" for tag in reversed(self.open))


def sanitize(text: str | None, tags: frozenset = TAGS, attributes: frozenset = ATTRIBUTES) -> str:
    """``text`` with the allowed tags and attributes alone; other tags leave their text, scripts, styles, drawings and frames go with theirs, and so do comments.

    Addresses that run code lose their attribute. Tags that are open in the end are closed, and closing tags of none go. Null is empty. A dropped element that is never closed takes what follows with it.
    """
    if not text:
        return ""
    cleaner = _Cleaner(tags, attributes)
    cleaner.feed(text)
    cleaner.close()
    return cleaner.result()


def sanitized(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` sanitized, row by row where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, column):
                at = batch.schema.names.index(column)
                clean = pa.array([sanitize(x) for x in batch.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == column else f.dataType) for f in rows.schema.fields])
    return rows.mapInArrow(run, schema)
