"""Codes, captions and links held as text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F

from popweave.functions.numbers import ColumnOrName, as_col

# English month names, in calendar order.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def zero_pad(c: ColumnOrName, width: int) -> Column:
    """Left-pad with zeros; a longer value is left whole (``lpad`` alone would cut it)."""
    c = as_col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def area_id(*parts: ColumnOrName) -> Column:
    """Compose an area id from its parts; missing if any part is."""
    return F.concat(*[as_col(p) for p in parts])


def last_chars(c: ColumnOrName, n: int) -> Column:
    return F.right(as_col(c), F.lit(n))


def first_digits(c: ColumnOrName) -> Column:
    """First run of digits, NULL when there is none."""
    return F.nullif(F.regexp_extract(as_col(c), r"(\d+)", 1), F.lit(""))


def strip_suffix_text(c: ColumnOrName, text: str) -> Column:
    """Remove a literal wherever it occurs."""
    return F.replace(as_col(c), F.lit(text), F.lit(""))


def strip_tags(c: ColumnOrName) -> Column:
    return F.regexp_replace(as_col(c), "<.*?>", "")


def unescape(c: ColumnOrName) -> Column:
    """Resolve all character references, named and numeric, once each, as the HTML standard does."""

    @F.pandas_udf("string")
    def resolved(values: pd.Series) -> pd.Series:
        return values.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)

    return resolved(as_col(c))


def caption_month(c: ColumnOrName) -> tuple[Column, Column]:
    """(year, month) of the first "Month YYYY" in a caption, NULL when absent."""
    pattern = r"(?i)\b(" + "|".join(MONTHS) + r")\s+(\d{4})"
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), i)])
    month = F.try_element_at(numbers, F.lower(F.regexp_extract(as_col(c), pattern, 1)))
    return F.regexp_extract(as_col(c), pattern, 2).try_cast("int"), month


def caption_flag(c: ColumnOrName, word: str) -> Column:
    """Whether the word occurs on its own in the caption, in any case."""
    return F.regexp_like(as_col(c), F.lit(rf"(?i)\b{word}\b"))


def snapshot_slug(year: Column, month: Column, flag: Column, url: Column, tag: str, page_suffix: str) -> Column:
    """``YYYY-MM`` with the tag when flagged; the page's last path segment when the month is unknown."""
    dated = F.concat(
        F.format_string("%04d-%02d", year, month),
        F.when(flag, F.lit(f"-{tag}")).otherwise(F.lit("")),
    )
    segment = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    return F.when(year.isNotNull() & month.isNotNull(), dated).otherwise(F.replace(segment, F.lit(page_suffix), F.lit("")))


def any_cell_matches(cells: ColumnOrName, pattern: str) -> Column:
    return F.exists(as_col(cells), lambda v: F.coalesce(v.rlike(f"(?i){pattern}"), F.lit(False)))


def prefixed_label(prefix: str, code: ColumnOrName) -> Column:
    return F.concat(F.lit(f"{prefix} "), as_col(code).cast("string"))


def site_url(href: ColumnOrName, base: str) -> Column:
    """Link target on a known site: rooted, absolute, or plain relative."""
    href = as_col(href)
    return (
        F.when(href.startswith("/"), F.concat(F.lit(base), href))
        .when(href.startswith("http"), href)
        .otherwise(F.concat(F.lit(f"{base}/"), F.ltrim(href, F.lit("/"))))
    )


def resolve_url(href: ColumnOrName, page_url: ColumnOrName) -> Column:
    """Resolve a link against the page that holds it."""
    href, page = as_col(href), as_col(page_url)
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    no_query = F.concat(site, path)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, _without_steps(href)))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(page, "^([^#]*)", 1), href))
        .when(href == "", page)
        .otherwise(F.concat(site, _without_steps(F.concat(folder, href))))
    )


def _without_steps(target: Column) -> Column:
    """A rooted path, with what follows it, whose ``.`` and ``..`` steps are taken; steps above the root lead to the root."""
    parts = F.split(F.regexp_extract(target, r"^/([^?#]*)", 1), "/")
    tail = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    taken = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done)
        .when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, p)),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(taken, F.lit(""))).otherwise(taken)
    return F.concat(F.lit("/"), F.array_join(ends, "/"), tail)
