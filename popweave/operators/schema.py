"""Column resolution at plan time. Nothing here looks at data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case all names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def pick_column(df: DataFrame, names: list[str], required: bool = False) -> str | None:
    """First candidate that exists, in candidate order, ignoring case."""
    have = {c.strip().lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    if found is None and required:
        raise ValueError(f"none of {names} in {df.columns}")
    return found


def pick_column_regex(df: DataFrame, patterns: list[str]) -> str | None:
    """First column that matches, trying the patterns in order, ignoring case."""
    return next((c for p in patterns for c in df.columns if re.search(p, c, re.I)), None)


def keep_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[c for c in keep if c in df.columns])


def require_columns(df: DataFrame, names: list[str], on_missing: str = "fail") -> DataFrame | None:
    """The frame itself if it has all columns; otherwise an error, or None with ``on_missing="skip"``."""
    missing = [n for n in names if n not in df.columns]
    if not missing:
        return df
    if on_missing == "skip":
        return None
    raise ValueError(f"missing columns {missing}")


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the named columns in order; absent ones are NULL of the given type."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in schema.items()])


def tidy(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select ``{tidy name: source name}``, source names ignoring case; an absent source is a NULL text column."""
    picked = {new: pick_column(df, [old]) for new, old in mapping.items()}
    return df.select(
        *[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(new) for new, c in picked.items()]
    )


def rename_alternates(df: DataFrame, alternates: dict[str, list[str]]) -> DataFrame:
    """Rename the first existing alternate of each target to the target."""
    renames = {}
    for target, names in alternates.items():
        found = pick_column(df, [target, *names])
        if found and found != target:
            renames[found] = target
    return df.withColumnsRenamed(renames)


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "which", value: str = "value") -> DataFrame:
    """One row per id row and value column; missing values are kept."""
    return df.unpivot(ids, values, variable, value)


def tag(df: DataFrame, **constants) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})
