"""Tables and links of landed web pages.

A page is one row. Its tables stay nested in that row, so choosing a table, finding its header and dropping repeated
headers are row-local expressions: no shuffle happens before rows are exploded, however many rows one page holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape as unescape_html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.geometry import bind
from popweave.functions.numbers import ColumnOrName, as_col
from popweave.functions.predicates import link_matches
from popweave.functions.text import caption_flag, caption_month, resolve_url, site_url, strip_tags, unescape
from popweave.session import ship_package

TABLES_TYPE = "array<array<array<string>>>"
TABLES_ARROW = pa.list_(pa.list_(pa.list_(pa.string())))

_HIDDEN = re.compile(r"""style\s*=\s*["']?[^"'>]*display\s*:\s*none""", re.I)
_SPAN = re.compile(r"""(col|row)span\s*=\s*["']?\s*(\d+)""", re.I)
# comments and code are skipped whole; a tag ends at the first > outside quotes
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|$)|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)((?:[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*>)""",
    re.I | re.S,
)
_PARTS = {"thead": 0, "tbody": 1, "tfoot": 2}


class _Table:
    """One open table: its rows by part, and the row and cell being read."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.rows: list[list] = [[], [], []]
        self.part = 1
        self.row: list | None = None
        self.row_hidden = False
        self.cell: list[str] | None = None
        self.spans: dict[str, int] = {}
        self.cell_hidden = False

    def end_cell(self) -> None:
        if self.cell is None:
            return
        if not self.cell_hidden:
            text = " ".join(unescape_html("".join(self.cell)).split())
            self.row.append((text or None, self.spans.get("col", 1), self.spans.get("row", 1)))
        self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row and not self.row_hidden:
            self.rows[self.part].append(self.row)
        self.row = None

    def begin(self, tag: str, attributes: str) -> None:
        if tag in _PARTS:
            self.end_row()
            self.part = _PARTS[tag]
        elif tag == "tr":
            self.end_row()
            self.row, self.row_hidden = [], bool(_HIDDEN.search(attributes))
        elif tag in ("td", "th"):
            if self.row is None:
                self.row, self.row_hidden = [], False
            self.end_cell()
            self.cell, self.spans, self.cell_hidden = [], {}, False
            if attributes != ">":
                self.spans = {k.lower(): max(int(n), 1) for k, n in _SPAN.findall(attributes)}
                self.cell_hidden = bool(_HIDDEN.search(attributes))

    def end(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag in _PARTS:
            self.end_row()
            self.part = 1

    def finish(self) -> list:
        self.end_row()
        return _expand(self.rows[0] + self.rows[1] + self.rows[2])


def _read_tables(html: str | None) -> list:
    """Rows of cell texts of every table of a page, spans repeated, head before body before foot."""
    if not html:
        return []
    done: list[tuple[int, list]] = []
    stack: list[_Table] = []
    seen = at = 0

    def close() -> None:
        table = stack.pop()
        rows = table.finish()
        if any(cell for row in rows for cell in row):
            done.append((table.number, rows))

    for mark in _MARKUP.finditer(html):
        if stack:
            # text of a nested table is also text of the cells around it
            for table in stack:
                if table.cell is not None:
                    table.cell.append(html[at : mark.start()])
        at = mark.end()
        tag = (mark[3] or "").lower()
        if tag == "table":
            if mark[2]:
                if stack:
                    close()
            else:
                stack.append(_Table(seen))
                seen += 1
        elif stack and tag:
            if mark[2]:
                stack[-1].end(tag)
            elif tag == "br" and stack[-1].cell is not None:
                stack[-1].cell.append(" ")
            else:
                stack[-1].begin(tag, mark[4])
    for table in stack:
        if table.cell is not None:
            table.cell.append(html[at:])
    while stack:
        close()
    return [rows for _, rows in sorted(done, key=lambda t: t[0])]


def _expand(rows: list) -> list[list[str | None]]:
    """Repeat cells over their column and row spans and pad short rows."""
    pending: dict[int, tuple[str | None, int]] = {}
    out = []
    for row in rows:
        cells: list[str | None] = []

        def carry():
            while len(cells) in pending:
                at = len(cells)
                text, left = pending.pop(at)
                cells.append(text)
                if left > 1:
                    pending[at] = (text, left - 1)

        fresh = {}
        for text, cols, down in row:
            carry()
            for _ in range(cols):
                if down > 1:
                    fresh[len(cells)] = (text, down - 1)
                cells.append(text)
        carry()
        pending.update(fresh)
        out.append(cells)
    width = max((len(r) for r in out), default=0)
    return [r + [None] * (width - len(r)) for r in out]


def extract_html_tables(pages: DataFrame, html: str = "html", out: str = "tables") -> DataFrame:
    """Add the page's tables, each a list of rows of cell texts. Pages without a table tag never reach Python's parser."""
    ship_package(pages.sparkSession)

    @F.arrow_udf(TABLES_TYPE)
    def tables_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_read_tables(html) for html in batch.to_pylist()], TABLES_ARROW)

    # declared nondeterministic only so that filters on what follows cannot parse every page a second time
    tables_of = tables_of.asNondeterministic()
    markup = F.when(F.regexp_like(F.col(html), F.lit("(?i)<table[\\s>]")), F.col(html))
    return pages.withColumn(out, tables_of(markup))


def table_width(table: Column) -> Column:
    """Rows are padded on extraction, so the first one tells the width."""
    return F.coalesce(F.size(F.get(table, F.lit(0))), F.lit(0))


def widest_table(tables: ColumnOrName, min_rows: int) -> Column:
    """Table with the most columns among those with enough rows; the first of equals; NULL when there is none."""
    usable = F.filter(as_col(tables), lambda t: F.size(t) >= min_rows)
    # one look at each: the place tells equals apart, so tables themselves are never compared
    ranked = F.transform(usable, lambda t, i: F.struct(table_width(t).alias("width"), (-i).alias("place"), t.alias("table")))
    return F.array_max(ranked)["table"]


def header_row(rows: Column, tokens: str, scan: int = 50) -> Column:
    """One-based place of the first row, among the first ``scan``, with a cell that matches; 0 when there is none."""
    from popweave.functions.text import any_cell_matches

    return F.array_position(F.transform(F.slice(rows, 1, scan), lambda r: any_cell_matches(r, tokens)), True).cast("int")


def _tail(rows: Column, start: Column) -> Column:
    return F.slice(rows, start, F.greatest(F.size(rows) - start + 1, F.lit(0)))


def main_table(df: DataFrame, tables: str = "tables", html: str = "html", url: str = "url", tokens: str | None = None) -> DataFrame:
    """Choose each page's source and resolve its header.

    Adds ``source`` ("table", "headerless", "csv_link" or NULL), ``header``, ``rows`` and ``csv_url``. A table whose first
    row can be its header comes first, then a table where the header has to be found by its words, then a CSV link.
    """
    kept = [c for c in df.columns if c != tables]
    picked = df.withColumns(
        {"_headed": widest_table(tables, 2), "_bare": widest_table(tables, 1), "csv_url": first_csv_link(html, url)}
    )
    # a header is looked for only where the first row can't be it
    found = F.when(F.col("_headed").isNull(), header_row(F.col("_bare"), tokens)) if tokens else F.lit(0)
    numbered = F.transform(
        F.sequence(F.lit(0), F.greatest(table_width(F.col("_bare")) - 1, F.lit(0))), lambda i: i.cast("string")
    )
    picked = picked.withColumn("_at", found)
    headed, bare = F.col("_headed").isNotNull(), F.col("_bare").isNotNull()
    trim_all = lambda row: F.transform(row, lambda c: F.trim(c))
    return picked.select(
        *kept,
        "csv_url",
        F.when(headed, "table").when(bare, "headerless").when(F.col("csv_url").isNotNull(), "csv_link").alias("source"),
        F.when(headed, trim_all(F.get("_headed", F.lit(0))))
        .when(bare & (F.col("_at") > 0), trim_all(F.element_at("_bare", F.greatest(F.col("_at"), F.lit(1)))))
        .when(bare, numbered)
        .alias("header"),
        F.when(headed, _tail(F.col("_headed"), F.lit(2)))
        .when(bare, _tail(F.col("_bare"), F.coalesce(F.col("_at"), F.lit(0)) + 1))
        .alias("rows"),
    )


def promote_header(df: DataFrame, rows: str, tokens: str, scan: int = 50) -> DataFrame:
    """Split nested rows into ``header`` and the rows below it; without a match the header is NULL and all rows stay."""
    located = df.withColumn("_at", header_row(F.col(rows), tokens, scan))
    header = F.when(F.col("_at") > 0, F.transform(F.element_at(rows, F.greatest(F.col("_at"), F.lit(1))), lambda c: F.trim(c)))
    return located.withColumns({"header": header, rows: _tail(F.col(rows), F.col("_at") + 1)}).drop("_at")


def drop_repeated_headers(df: DataFrame, header: str = "header", rows: str = "rows") -> DataFrame:
    """Drop rows whose set of values equals the set of header names, and rows without any value."""

    def as_set(cells: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(cells, lambda c: F.coalesce(F.trim(c), F.lit("")))))

    names = as_set(F.col(header))
    return df.withColumn(
        rows,
        F.filter(
            rows,
            lambda r: F.exists(r, lambda c: c.isNotNull()) & F.coalesce(as_set(r) != names, F.lit(True)),
        ),
    )


def column_index(header: ColumnOrName, patterns: list[str]) -> Column:
    """Zero-based place of the first header name to match, trying the patterns in order; NULL when none does.

    The per-row counterpart of ``pick_column_regex``, for pages whose headers differ.
    """
    header = as_col(header)
    places = [
        F.nullif(
            F.array_position(
                F.transform(header, lambda h: F.coalesce(h.rlike(f"(?i){p}"), F.lit(False))), True
            ),
            F.lit(0),
        )
        for p in patterns
    ]
    return F.coalesce(*places).cast("int") - 1


def table_cells(df: DataFrame, keep: list[str], tables: str = "tables") -> DataFrame:
    """Long form: one row per table row, with ``table_no`` and ``row_no`` from 0."""
    per_table = df.select(*keep, F.posexplode(tables).alias("table_no", "_rows"))
    return per_table.select(*keep, "table_no", F.posexplode("_rows").alias("row_no", "cells"))


# an attribute is a name and perhaps a value, between double or single quotes or without any
ATTRIBUTE = r"""[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+"""
TARGET = r"""href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++))"""
ANCHOR = rf"(?is)<a(?=\s)(?:[\s/]++(?!href\s*=){ATTRIBUTE})*+[\s/]++{TARGET}(?:[\s/]*+{ATTRIBUTE})*+[\s/]*+>(.*?)</a\s*>"


def extract_links(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(href, text) of every anchor that has a target, in page order, tags inside the text removed."""
    names = ["double", "single", "bare", "text"]
    groups = [F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    found = F.filter(F.arrays_zip(*groups), lambda a: F.concat(a["double"], a["single"], a["bare"]) != "")
    rows = pages.select(*keep, F.posexplode(found).alias("link_no", "_l"))
    href = F.concat("_l.double", "_l.single", "_l.bare")
    return rows.select(*keep, "link_no", href.alias("href"), F.trim(strip_tags("_l.text")).alias("text"))


def link_catalogue(
    pages: DataFrame, base: str, flag_word: str, contains: str = "", ends: str = "", page_id: str = "page_id", html: str = "html"
) -> DataFrame:
    """Distinct data links (url, text, year, month, flag), the first occurrence of each, oldest caption first in order."""
    from popweave.operators.ranking import first_per_key

    links = extract_links(pages, [page_id], html).where(link_matches("href", contains, ends))
    year, month = caption_month("text")
    described = links.select(
        page_id,
        "link_no",
        site_url("href", base).alias("url"),
        "text",
        year.alias("year"),
        month.alias("month"),
        caption_flag("text", flag_word).alias("flag"),
    )
    return first_per_key(described, ["url"], [page_id, "link_no"]).drop(page_id, "link_no")


# a target that names a CSV file, or the attribute that holds one, in either kind of quotes
CSV_LINK = r"""(?i)\bhref\s*+=\s*+(?:"([^"]*?\.csv[^"]*+)"|'([^']*?\.csv[^']*+)')|\bdata-csv-url\s*+=\s*+(?:"([^"]++)"|'([^']++)')"""


def first_csv_link(html: ColumnOrName, url: ColumnOrName) -> Column:
    """First CSV link of a page, resolved against the page; NULL when there is none."""
    html = as_col(html)
    # plain searches first: most pages have no such link, and the pattern is slow to find that out
    low = F.lower(html)
    near = F.contains(low, F.lit(".csv")) | F.contains(low, F.lit("data-csv-url"))
    found = F.regexp_extract(html, CSV_LINK, 0)
    target = F.when(near, F.nullif(F.regexp_extract(found, r"""(?s)["'](.*)["']$""", 1), F.lit("")))
    # the target is worked out once, though resolving mentions it often
    return bind(unescape(target), lambda t: F.when(t.isNotNull(), resolve_url(t, url)))
