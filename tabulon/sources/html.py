"""Tables and data-file links out of a column of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import col, require, type_of

# File extensions that count as data.
DATA_EXTENSIONS = ["csv", "tsv", "parquet", "json", "jsonl", "xls", "xlsx"]
TEXT_LIMIT = 60


class _TableParser(HTMLParser):
    """Collects rows of cell text per table; nested tables count on their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, str, list[list[str]]]] = []
        self.open: list[dict] = []
        self.count = 0
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.open.append({"no": self.count, "rows": [], "cell": None, "caption": None})
            self.count += 1
        elif self.open:
            table = self.open[-1]
            if tag == "tr":
                self._close_cell(table)
                table["rows"].append([])
            elif tag in ("td", "th"):
                self._close_cell(table)
                if not table["rows"]:
                    table["rows"].append([])
                table["cell"] = []
            elif tag == "caption":
                table["caption"] = []
            elif tag == "br" and table["cell"] is not None:
                table["cell"].append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.open:
            table = self.open[-1]
            if tag in ("td", "th", "tr"):
                self._close_cell(table)
            elif tag == "caption" and isinstance(table["caption"], list):
                table["caption"] = " ".join("".join(table["caption"]).split())
            elif tag == "table":
                self._finish()

    def handle_data(self, data):
        if self.skip or not self.open:
            return
        table = self.open[-1]
        if table["cell"] is not None:
            table["cell"].append(data)
        elif isinstance(table["caption"], list):
            table["caption"].append(data)

    def close(self):
        super().close()
        while self.open:
            self._finish()

    @staticmethod
    def _close_cell(table):
        if table["cell"] is not None:
            text = "".join(table["cell"])
            lines = [" ".join(line.split()) for line in text.split("\n")]
            table["rows"][-1].append("\n".join(line for line in lines if line))
            table["cell"] = None

    def _finish(self):
        table = self.open.pop()
        self._close_cell(table)
        caption = table["caption"] if isinstance(table["caption"], str) else ""
        self.done.append((table["no"], caption, table["rows"]))


def tables_of(html: str) -> list[tuple[int, str, list[list[str]]]]:
    """(number, caption, rows) of tables with more than one row and a non-empty first row."""
    parser = _TableParser()
    parser.feed(html)
    parser.close()
    return sorted((t for t in parser.done if len(t[2]) > 1 and t[2][0]), key=lambda t: t[0])


def extract_html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per table row: (key, table_no, caption, rows, cols, row_no, cells)."""
    require(pages, key, html)
    kind = type_of(pages, key).simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch["k"], batch["h"]):
                for number, caption, rows in tables_of(text):
                    kept = [r for r in rows if r]
                    for place, cells in enumerate(kept):
                        out.append((page, number, caption, len(rows), len(rows[0]), place, cells))
            yield pd.DataFrame(out, columns=["k", "table_no", "caption", "rows", "cols", "row_no", "cells"])

    slim = pages.select(col(key).alias("k"), col(html).alias("h")).filter(F.col("h").contains("<"))
    found = slim.mapInPandas(
        parse, f"k {kind}, table_no int, caption string, rows int, cols int, row_no int, cells array<string>"
    )
    return found.withColumnRenamed("k", key)


ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _unescape(value):
    for name, text in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(text))
    return value


def extract_data_links(
    pages: DataFrame, key: str = "page_id", html: str = "html", base: str | None = "url"
) -> DataFrame:
    """Distinct links per page whose path ends in a data-file extension.

    Relative links are resolved against the page address.
    """
    require(pages, key, html)
    anchors = pages.select(
        col(key).alias(key),
        (col(base) if base else F.lit(None).cast("string")).alias("__base"),
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all(col(html), F.lit(ANCHOR), F.lit(1)).alias("attributes"),
                F.regexp_extract_all(col(html), F.lit(ANCHOR), F.lit(2)).alias("inner"),
            )
        ).alias("__at", "__a"),
    )
    attributes = F.col("__a.attributes")
    raw = F.trim(_unescape(F.concat(*[F.regexp_extract(attributes, HREF, i) for i in (1, 2, 3)])))
    site = F.regexp_extract("__base", r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract("__base", r"^([a-zA-Z][\w+.-]*:)", 1)
    folder = F.regexp_extract("__base", r"^([a-zA-Z][\w+.-]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/")))
    href = (
        F.when(raw.rlike(r"^[a-zA-Z][\w+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, raw))
        .when(raw.startswith("/"), F.concat(site, raw))
        .otherwise(F.concat(folder, raw))
    )
    path = F.regexp_extract(F.col("href"), r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    text = F.trim(F.regexp_replace(_unescape(F.regexp_replace(F.col("__a.inner"), "<[^>]*>", "")), r"\s+", " "))
    filename = F.element_at(F.split(F.col("path"), "/"), -1)
    found = (
        anchors.filter(raw != "")
        .withColumn("href", href)
        .withColumn("path", path)
        .filter(F.col("path").rlike(r"(?i)\.(" + "|".join(DATA_EXTENSIONS) + ")$"))
        .select(key, "href", "__at", filename.alias("filename"), F.substring(text, 1, TEXT_LIMIT).alias("text"))
    )
    firsts = found.groupBy(key, "href").agg(F.min_by(F.struct("filename", "text"), "__at").alias("f"))
    return firsts.select(
        key, "href", "f.filename", F.when(F.col("f.text") == "", F.col("f.filename")).otherwise(F.col("f.text")).alias("text")
    )
