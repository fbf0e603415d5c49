"""Weighted counts, shares, rates and profiles of person records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from popweave.functions.codes import ATTAINMENT_PROFILE, Bins, bin_codes, person_flags
from popweave.functions.numbers import half_even, lenient_sum, number, safe_div, total
from popweave.functions.predicates import keys_present, parse_filters, slots_matching
from popweave.operators.order_statistics import order_statistics
from popweave.session import cut_lineage


def measure(df: DataFrame, name: str) -> Column:
    """Whole numbers as long, other numbers and text as double."""
    if isinstance(df.schema[name].dataType, IntegralType):
        return F.col(name).cast("long")
    return number(df, name)


def _keyed(df: DataFrame, by: list[str], null_keys: str) -> DataFrame:
    if null_keys not in ("keep", "drop"):
        raise ValueError("null_keys is keep or drop")
    return df.where(keys_present(by)) if by and null_keys == "drop" else df


def weighted_count(df: DataFrame, by: list[str], weight: str, out: str = "weighted_count", null_keys: str = "keep") -> DataFrame:
    """Sum of weights per group; the group of the missing key is kept unless asked otherwise."""
    return _keyed(df, by, null_keys).groupBy(*by).agg(total(measure(df, weight)).alias(out))


def group_sum(df: DataFrame, by: list[str], value: str, out: str | None = None) -> DataFrame:
    """Sum per group, rows with a missing key left out."""
    return weighted_count(df, by, value, out or value, null_keys="drop")


def sum_or_total(df: DataFrame, by: list[str | None], value: str, out: str = "total") -> DataFrame:
    """Sum by the keys that could be resolved; one overall row when none could."""
    keys = [k for k in by if k]
    return group_sum(df, keys, value, out) if keys else df.agg(total(measure(df, value)).alias(out))


def row_sum_by_prefix(df: DataFrame, prefixes: list[str], out: str, exclude: list[str] | None = None) -> DataFrame:
    """Row-wise sum of all columns whose name starts with a prefix, missing parts as 0."""
    skip = {e.lower() for e in (exclude or [])}
    cols = [
        c for c in df.columns if any(c.lower().startswith(p.lower()) for p in prefixes) and c.lower() not in skip
    ]
    return df.withColumn(out, lenient_sum(*[number(df, c) for c in cols]))


def tabulate(df: DataFrame, variable: str, filters: dict[str, str], weight: str) -> DataFrame:
    """Weighted count per code of a variable under filters in the mini-grammar of ``parse_filters``."""
    rows = df.where(parse_filters(filters)).select(F.col(variable).alias("code"), F.col(weight))
    return weighted_count(rows, ["code"], weight, null_keys="drop")


def tabulate_slots(
    df: DataFrame, variable: str, filters: dict[str, str], weight: str, slots: list[str], code
) -> DataFrame:
    """Sum of one tabulation per slot: a person whose slots both match counts twice. One scan for all slots."""
    rows = df.where(parse_filters(filters)).select(
        F.col(variable).alias("code"), (measure(df, weight) * slots_matching(slots, code)).alias("_w"),
        slots_matching(slots, code).alias("_n"),
    )
    return weighted_count(rows.where(F.col("_n") > 0), ["code"], "_w", null_keys="drop")


def indicator_mix(
    df: DataFrame,
    variables: list[str],
    weight: str,
    yes: str = "1",
    slots: list[str] | None = None,
    code=None,
    universe: Column | None = None,
) -> DataFrame:
    """(variable, weighted_count) of "yes" answers to every indicator, in one scan; optionally per matching slot.

    With a universe, the weight of its rows comes along as ``universe``, from the same scan.
    """
    w = measure(df, weight)
    if slots:
        w = w * slots_matching(slots, code)
    sums = [
        total(F.when(F.trim(F.col(v).cast("string")) == yes, w)).alias(v) for v in variables
    ]
    whole = [total(F.when(universe, w)).alias("universe")] if universe is not None else []
    return df.agg(*sums, *whole).unpivot(["universe"] if whole else [], variables, "variable", "weighted_count")


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each row's share of the column total, taken before any limit. The total is one scalar, not a join.

    On an aggregate the total reads the aggregate's own shuffle again rather than the input.
    """
    return df.withColumn(out, safe_div(F.col(value), df.select(F.sum(value)).scalar()))


def scaled_to_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Each value over the column maximum."""
    return df.withColumn(out, safe_div(F.col(value), df.select(F.max(value)).scalar()))


def conditional_sums(df: DataFrame, by: list[str], weight: str, conditions: dict[str, Column], null_keys: str = "drop") -> DataFrame:
    """Weight of the rows that meet each condition, all in one pass."""
    w = measure(df, weight)
    return _keyed(df, by, null_keys).groupBy(*by).agg(
        *[total(F.when(cond, w)).alias(name) for name, cond in conditions.items()]
    )


def mean_of(value: Column, weight: Column) -> Column:
    """Weighted mean, NULL for zero weight; a missing value adds nothing but its weight counts."""
    return safe_div(F.sum(value * weight), F.sum(weight))


def rate_of(numerator: Column, universe: Column, weight: Column) -> Column:
    """Weight share of the numerator within a universe, NULL for an empty one."""
    return safe_div(F.sum(F.when(universe & numerator, weight)), F.sum(F.when(universe, weight)))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, out: str = "mean", null_keys: str = "drop") -> DataFrame:
    return _keyed(df, by, null_keys).groupBy(*by).agg(mean_of(number(df, value), number(df, weight)).alias(out))


def weighted_median(
    df: DataFrame,
    by: list[str],
    value: str,
    weight: str,
    out: str = "median",
    null_as_zero: bool = False,
    null_keys: str = "drop",
) -> DataFrame:
    """Smallest value at which the running weight reaches half the total; no interpolation."""
    x = number(df, value)
    rows = _keyed(df, by, null_keys).select(
        *by, (F.coalesce(x, F.lit(0.0)) if null_as_zero else x).alias("_x"), measure(df, weight).alias("_w")
    )
    found = order_statistics(rows, by, "_x", "_w", {out: lambda whole: whole / 2}, null_keys=null_keys)
    return found.select(*by, out)


def pivot_sum(
    df: DataFrame, index: list[str], column: str, value: str, values: list | None = None, row_total: str | None = None, prefix: str = ""
) -> DataFrame:
    """One column per value, or per listed value only, missing combinations as 0; optionally a total over these columns.

    Without a list, more values than ``spark.sql.pivotMaxValues`` are an error, and no more than that come to the driver.
    """
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        there = df.where(keys_present([*index, column])).select(F.col(column).alias("v")).distinct()
        values = [r["v"] for r in there.limit(most + 1).orderBy("v").collect()]
        if len(values) > most:
            raise ValueError(f"column {column} has more than {most} values (spark.sql.pivotMaxValues); list those to pivot")
    names = [f"{prefix}{v}" for v in values]
    wide = df.where(keys_present([*index, column])).groupBy(*index).pivot(column, values).agg(F.sum(measure(df, value)))
    wide = wide.toDF(*index, *names).fillna(0, subset=names)
    return wide.withColumn(row_total, sum((F.col(f"`{n}`") for n in names), F.lit(0))) if row_total else wide


def has_rows(df: DataFrame) -> bool:
    """Stops at the first row found."""
    return not df.isEmpty()


def group_profile(
    df: DataFrame,
    by: list[str],
    weight: str = "PWGTP",
    age: str = "AGEP",
    education: str = "SCHL",
    labour: str = "ESR",
    income: str = "PINCP",
    nativity: str = "NATIVITY",
    bins: Bins = ATTAINMENT_PROFILE,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Population, nativity, education, income and employment of every group, counts and shares.

    Missing income counts as 0 in mean and median. Shares are of the rounded counts and always present. The sums per group and
    income are checkpointed.
    """
    names = names or {"<HS": "edu_lt_hs", "HS": "edu_hs", "Some/AA": "edu_some_aa", "BA": "edu_ba", "Grad+": "edu_grad_plus"}
    w = F.coalesce(measure(df, weight), F.lit(0))
    flags = person_flags(number(df, age), number(df, nativity), number(df, labour))
    attained = bin_codes(F.coalesce(number(df, education), F.lit(-1.0)), bins)
    income_or_0 = F.coalesce(number(df, income), F.lit(0.0))
    rows = df.where(keys_present(by)).select(
        *by, w.alias("w"), income_or_0.alias("income"), attained.alias("edu"), *[c.alias(n) for n, c in flags.items()]
    )
    universe = F.col("adult") & F.col("in_labour_force")
    parts = {
        "pop": F.col("w"),
        "native": F.when(F.col("native"), F.col("w")),
        "foreign": F.when(F.col("foreign"), F.col("w")),
        **{names[cat]: F.when(F.col("edu") == cat, F.col("w")) for cat, _, _ in bins},
    }
    work = {"_working": F.when(universe & F.col("employed"), F.col("w")), "_universe": F.when(universe, F.col("w"))}
    # one row per group and income carries every sum, and feeds counts and median alike: the input is read once
    merged = rows.groupBy(*by, "income").agg(
        *[total(c).alias(n) for n, c in parts.items()], *[F.sum(c).alias(n) for n, c in work.items()]
    )
    merged = cut_lineage(merged)
    counted = merged.groupBy(*by).agg(
        *[total(n).alias(n) for n in parts],
        mean_of(F.col("income"), F.col("pop")).alias("income_mean"),
        safe_div(F.sum("_working"), F.sum("_universe")).alias("employment_rate"),
    )
    medians = order_statistics(merged, by, "income", "pop", {"income_median": lambda whole: whole / 2}).drop("total")
    counts = ["pop", "native", "foreign", *names.values()]
    wide = counted.join(medians, by, "left").withColumns({c: half_even(c) for c in counts})
    # a group without weight has an employment rate of nothing, not of zero
    shares = {f"pct_{c}": safe_div(c, "pop") for c in counts[1:]}
    return wide.withColumns(shares).select(
        *by, *counts, "income_mean", "income_median", "employment_rate", *shares
    )
