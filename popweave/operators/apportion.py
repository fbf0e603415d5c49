"""Estimates and margins of error carried from source areas to target areas."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.numbers import half_even, num, number
from popweave.functions.predicates import keys_present
from popweave.functions.text import first_digits, last_chars, zero_pad
from popweave.operators.schema import pick_column

# Header names under which published crosswalks hold their columns, in order of preference.
TARGET_NAMES = ["zip", "zip_code", "zipcode", "zcta5"]
SOURCE_NAMES = ["tract", "census_tract", "geoid", "tract_geoid", "geotract"]
RATIO_NAMES = ["res_ratio", "residential_ratio", "ratio_res", "ratio"]
NESTED_SOURCE_NAMES = ["tract", "geoid", "tract_geoid", "bctcb2020", "tractid", "geoid20"]
NESTED_CODE_NAMES = ["nta2020", "ntacode", "nta_code", "nta"]
NESTED_LABEL_NAMES = ["ntaname", "nta_name", "name", "ntaname2020"]

FULL_KEY, SHORT_KEY = 11, 6


def load_crosswalk(raw: DataFrame) -> DataFrame:
    """(zip, tract, weight) from a published crosswalk read as text; an unreadable ratio is 0."""
    target, source, ratio = (pick_column(raw, n, required=True) for n in (TARGET_NAMES, SOURCE_NAMES, RATIO_NAMES))
    return raw.select(
        zero_pad(F.col(f"`{target}`"), 5).alias("zip"),
        first_digits(F.col(f"`{source}`")).alias("tract"),
        F.coalesce(number(raw, ratio), F.lit(0.0)).alias("weight"),
    )


def load_nested_crosswalk(raw: DataFrame) -> DataFrame:
    """(tract, nta[, ntaname]) from a published nesting table."""
    source, code = (pick_column(raw, n, required=True) for n in (NESTED_SOURCE_NAMES, NESTED_CODE_NAMES))
    name = pick_column(raw, NESTED_LABEL_NAMES)
    extra = [F.col(f"`{name}`").alias("ntaname")] if name else []
    return raw.select(first_digits(F.col(f"`{source}`")).alias("tract"), F.col(f"`{code}`").alias("nta"), *extra)


def _width(xwalk: DataFrame, source: str) -> DataFrame:
    """One row: 11 if the median length of the keys is 10 or more, else 6."""
    median = F.percentile(F.length(source), 0.5)
    return xwalk.agg(F.when(median >= 10, FULL_KEY).otherwise(SHORT_KEY).alias("width"))


def crosswalk_key(xwalk: DataFrame, source: str = "tract") -> int:
    """Key width of a crosswalk, 11 or 6 digits, by the median length of its keys: one small action."""
    return _width(xwalk, source).first()["width"]


def _keys(area: Column, xwalk: DataFrame, source: str, digits: int | None) -> tuple[Column, Column]:
    """Keys of the areas and of the crosswalk. Without ``digits`` the plan itself finds the width, as a scalar subquery."""
    if digits not in (None, FULL_KEY, SHORT_KEY):
        raise ValueError("key_digits is 11 or 6")
    if digits != FULL_KEY:
        found = "" if digits else ", should the crosswalk have them"
        warnings.warn(f"6-digit keys{found}, ignore the county: equal keys of several counties are all matched", stacklevel=3)
    full, short = (area, last_chars(source, FULL_KEY)), (last_chars(area, SHORT_KEY), F.col(source))
    if digits:
        return full if digits == FULL_KEY else short
    is_full = _width(xwalk, source).scalar() == FULL_KEY
    return F.when(is_full, full[0]).otherwise(short[0]), F.when(is_full, full[1]).otherwise(short[1])


def _per_key(stats: DataFrame, key: Column) -> DataFrame:
    """Estimate and variance per key. Both add up, so areas that share a key cannot multiply the join's rows."""
    est, moe = number(stats, "estimate"), number(stats, "moe")
    return stats.groupBy(key.alias("_key")).agg(
        F.coalesce(F.sum(est), F.lit(0.0)).alias("_est"), F.coalesce(F.sum(moe * moe), F.lit(0.0)).alias("_var")
    )


def apportion(
    stats: DataFrame,
    xwalk: DataFrame,
    key_digits: int | None = None,
    target: str = "zip",
    source: str = "tract",
    weight: str = "weight",
    area: str = "geoid",
    rounded: bool = True,
) -> DataFrame:
    """Weighted sums of estimates per target, margins as the root of summed squares; rounded half to even."""
    area_key, xwalk_key = _keys(F.col(area), xwalk, source, key_digits)
    w = number(xwalk, weight)
    bridge = xwalk.where(F.col(target).isNotNull()).select(target, xwalk_key.alias("_key"), w.alias("_w"))
    joined = bridge.join(_per_key(stats, area_key), "_key", "inner")
    out = joined.groupBy(target).agg(
        F.coalesce(F.sum(F.col("_est") * F.col("_w")), F.lit(0.0)).alias("estimate"),
        F.sqrt(F.coalesce(F.sum(F.col("_var") * F.col("_w") * F.col("_w")), F.lit(0.0))).alias("moe"),
    )
    return out.withColumns({"estimate": half_even("estimate"), "moe": half_even("moe")}) if rounded else out


def rollup_nested(
    stats: DataFrame,
    xwalk: DataFrame,
    key_digits: int | None = None,
    by: list[str] | None = None,
    source: str = "tract",
    area: str = "geoid",
    rounded: bool = True,
) -> DataFrame:
    """Sums of estimates over the sources nested in each target; grouped by code and, if there is one, name."""
    by = by or [c for c in ("nta", "ntaname") if c in xwalk.columns]
    area_key, xwalk_key = _keys(F.col(area), xwalk, source, key_digits)
    bridge = xwalk.where(keys_present(by)).select(*by, xwalk_key.alias("_key"))
    joined = bridge.join(_per_key(stats, area_key), "_key", "inner")
    out = joined.groupBy(*by).agg(
        F.coalesce(F.sum("_est"), F.lit(0.0)).alias("estimate"),
        F.sqrt(F.coalesce(F.sum("_var"), F.lit(0.0))).alias("moe"),
    )
    return out.withColumns({"estimate": half_even("estimate"), "moe": half_even("moe")}) if rounded else out


def area_estimates(raw: DataFrame, estimate: str, moe: str | None, counties: dict[str, list[str]] | None = None) -> DataFrame:
    """Typed area rows of a summary table with state, county and tract codes; kept to (state, county) pairs if given."""
    rows = raw
    if counties:
        pair = F.lit(False)
        for state, codes in counties.items():
            pair = pair | ((F.col("state") == state) & F.col("county").isin(codes))
        rows = rows.where(pair)
    typed = {"estimate": F.coalesce(num(estimate), F.lit(0.0))}
    if moe:
        typed["moe"] = F.coalesce(num(moe), F.lit(0.0))
    return rows.select(
        "state",
        "county",
        "tract",
        F.concat("state", "county", "tract").alias("geoid"),
        *[c.alias(n) for n, c in typed.items()],
    )


def read_area_stats(raw: DataFrame) -> DataFrame:
    """(geoid, estimate, moe) from a saved table that has either the id or its three parts."""
    if "geoid" not in raw.columns:
        if not {"state", "county", "tract"} <= set(raw.columns):
            raise ValueError("needs geoid, or state, county and tract")
        raw = raw.withColumn("geoid", F.concat("state", "county", "tract"))
    return raw.select(
        "geoid",
        F.coalesce(number(raw, "estimate"), F.lit(0.0)).alias("estimate"),
        F.coalesce(number(raw, "moe"), F.lit(0.0)).alias("moe"),
    )
