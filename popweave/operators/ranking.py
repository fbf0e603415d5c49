"""Sorting, top-N, first and latest rows, totals on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Order = list[tuple[str, str] | str]


def sort_key(spec: tuple[str, str] | str) -> Column:
    """Ascending name or (name, direction); missing values come last either way."""
    name, direction = (spec, "asc") if isinstance(spec, str) else spec
    c = F.col(name)
    return c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()


def sort_rows(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*[sort_key(o) for o in order])


def top_n(df: DataFrame, order: Order, n: int) -> DataFrame:
    """Global top rows; each task keeps its own n before they meet."""
    return sort_rows(df, order).limit(n)


def top_n_resorted(df: DataFrame, order: Order, n: int, then: Order) -> DataFrame:
    return sort_rows(top_n(df, order, n), then)


def top_n_per_group(df: DataFrame, by: list[str], order: Order, n: int, null_keys: str = "drop") -> DataFrame:
    """Top rows of each group.

    Spark applies the limit before the shuffle too, for n up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000),
    so a hot group arrives already small.
    """
    if null_keys == "drop":
        df = df.dropna(subset=by)
    w = Window.partitionBy(*by).orderBy(*[sort_key(o) for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def _pick_per_key(df: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    picked = df.groupBy(*keys).agg(chosen.alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """Row with the lowest position per key. Position columns must not be missing and must order the rows of a key."""
    rest = [c for c in df.columns if c not in keys]
    return _pick_per_key(df, keys, F.min_by(F.struct(*rest), F.struct(*position)))


def latest_per_key(df: DataFrame, keys: list[str], year: str, ties: list[str] | None = None) -> DataFrame:
    """Row with the latest year per key; an unknown year counts as latest. Ties go to the highest tie-break columns."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(year).isNull().alias("unknown"), F.col(year), *[F.col(t) for t in (ties or [])])
    return _pick_per_key(df, keys, F.max_by(F.struct(*rest), rank))


def with_group_total(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Each row with its group's total; rows without a key get none.

    Totals are aggregated and joined back, since a window would bring every row of a group to one task.
    """
    totals = df.dropna(subset=by).groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0)).alias(out))
    return df.join(totals, by, "left").select(*df.columns, out)


def first_match_index(df: DataFrame, by: list[str], index: str, matches: Column, scan: int = 50) -> DataFrame:
    """Lowest row index, among the first ``scan``, of the rows that match; NULL for a group without a match."""
    hit = F.when((F.col(index) < scan) & matches, F.col(index))
    return df.groupBy(*by).agg(F.min(hit).alias(index))
