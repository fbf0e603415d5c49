"""Row filters as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.numbers import ColumnOrName, as_col, num


def code_equals(c: ColumnOrName, code, as_string: bool = False) -> Column:
    """Code match: by value ("0370" is 370) or, with ``as_string``, by text."""
    if as_string:
        return as_col(c).cast("string") == F.lit(str(code))
    return num(as_col(c).cast("string")) == F.lit(float(code))


def any_slot(cols: list[ColumnOrName], code, as_string: bool = False) -> Column:
    """True when any slot holds the code. A person in two slots passes once; a missing slot does not hide a match."""
    return reduce(lambda a, b: a | b, [code_equals(c, code, as_string) for c in cols])


def slots_matching(cols: list[ColumnOrName], code, as_string: bool = False) -> Column:
    """Number of slots that hold the code."""
    hits = [F.when(code_equals(c, code, as_string), 1).otherwise(0) for c in cols]
    return reduce(lambda a, b: a + b, hits)


def folded_equals(c: ColumnOrName, value: str, trim: bool = True) -> Column:
    """Case-insensitive equality."""
    c = as_col(c).cast("string")
    return F.lower(F.trim(c) if trim else c) == F.lower(F.lit(value.strip() if trim else value))


def parse_filters(filters: dict[str, str]) -> Column:
    """Conjunction of ``"16:99"`` ranges, ``"1,2"`` lists and ``"370"`` equalities, by number where the text is one."""

    def is_number(text: str) -> bool:
        try:
            float(text)
        except ValueError:
            return False
        return True

    def one(name: str, spec: str) -> Column:
        parts = [p.strip() for p in spec.split(":")]
        if len(parts) == 2 and all(is_number(p) for p in parts):
            return num(F.col(name).cast("string")).between(float(parts[0]), float(parts[1]))
        items = [p.strip() for p in spec.split(",")]
        if all(is_number(p) for p in items):
            return num(F.col(name).cast("string")).isin([float(p) for p in items])
        return F.trim(F.col(name).cast("string")).isin(items)

    return reduce(lambda a, b: a & b, [one(n, s) for n, s in filters.items()], F.lit(True))


def in_codes(c: ColumnOrName, codes) -> Column:
    return as_col(c).isin(list(codes))


def in_range(c: ColumnOrName, low, high) -> Column:
    return as_col(c).between(low, high)


def year_month_between(year: ColumnOrName, month: ColumnOrName, start: str | None, end: str | None) -> Column:
    """Inclusive ``YYYY-MM`` window; a row whose year or month is unknown passes."""

    def ordinal(text: str) -> int:
        y, m = text.split("-")
        return int(y) * 100 + int(m)

    y, m = as_col(year), as_col(month)
    inside = F.lit(True)
    if start:
        inside = inside & (y * 100 + m >= ordinal(start))
    if end:
        inside = inside & (y * 100 + m <= ordinal(end))
    unknown = y.isNull() | m.isNull() | (y == 0) | (m == 0)
    return unknown | inside


def flagged(c: ColumnOrName, wanted: bool = True) -> Column:
    return as_col(c) if wanted else ~as_col(c)


def above_weight(c: ColumnOrName, eps: float = 1e-9) -> Column:
    return as_col(c) > F.lit(eps)


def within_cap(x: ColumnOrName, y: ColumnOrName, cap: float) -> Column:
    return (as_col(x) <= cap) & (as_col(y) <= cap)


def comparable(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Positive denominator and known numerator."""
    return (F.coalesce(as_col(denominator), F.lit(0)) > 0) & as_col(numerator).isNotNull()


def link_matches(href: ColumnOrName, contains: str, ends: str) -> Column:
    return F.contains(as_col(href), F.lit(contains)) & as_col(href).endswith(ends)


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows missing any of the given columns, or, without a list, rows missing all columns."""
    return df.dropna(subset=subset) if subset else df.dropna("all")


def keys_present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
