"""Tolerant numbers, rounding and ratios. Missing is always NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: ColumnOrName) -> Column:
    """Text to double; anything unparseable is NULL.

    The cast would also read Java literals such as ``1d`` or ``2.5F``, which are not numbers in a data file.
    """
    c = as_col(c)
    value = c.try_cast("double")
    last = F.lower(F.right(F.rtrim(c), F.lit(1)))
    java_suffix = last.isin("d", "f") & ~F.lower(F.rtrim(c)).endswith("inf")
    return F.when(~F.isnan(value) & ~java_suffix, value)


def number(df: DataFrame, name: str) -> Column:
    """``num`` for a text column, a plain cast for a column that already is a number."""
    if isinstance(df.schema[name].dataType, NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return num(name)


def count_int(c: ColumnOrName) -> Column:
    """Count with thousands commas to long; unparseable is 0."""
    return F.coalesce(num(F.replace(as_col(c), F.lit(","), F.lit(""))).try_cast("bigint"), F.lit(0).cast("bigint"))


def half_even(c: ColumnOrName) -> Column:
    """Round half to even, as a long."""
    return F.rint(as_col(c)).try_cast("bigint")


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """NULL where the denominator is zero or missing."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def total(c: ColumnOrName) -> Column:
    """Sum that skips missing values and is 0, not NULL, when all are missing."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def strict_sum(*cols: ColumnOrName) -> Column:
    """Row-wise sum, missing if any part is missing."""
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])


def lenient_sum(*cols: Column) -> Column:
    """Row-wise sum with missing parts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols], F.lit(0.0))


def percent(share: ColumnOrName) -> Column:
    """Share as a percentage with one decimal, half to even."""
    return F.bround(as_col(share) * 100, 1)


# Published factor between a 90 percent margin of error and one standard error.
Z_90 = 1.645


def coefficient_of_variation(estimate: ColumnOrName, moe: ColumnOrName) -> Column:
    return safe_div(as_col(moe).cast("double") / F.lit(Z_90), estimate)


def visibility(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Ratio where the denominator is positive and the numerator is known, else NULL."""
    n, d = as_col(numerator), as_col(denominator)
    return F.when((F.coalesce(d, F.lit(0)) > 0) & n.isNotNull(), safe_div(n, d))


def marker_size(value: ColumnOrName, maximum: Column) -> Column:
    """20 + 80 * sqrt(value / maximum), missing value as 0."""
    return F.lit(20.0) + F.lit(80.0) * F.sqrt(safe_div(F.coalesce(as_col(value), F.lit(0)), maximum))
