"""Exact weighted order statistics without sorting a whole group in one task.

Equal values of a group are merged first. The merged rows are cut into value buckets of about equal size, so that a group
holding a third of all rows spans a third of the buckets. Bucket weights give the running weight at each bucket's
start; only the buckets that hold a wanted rank are then sorted, each for itself. Data that fits one bucket gets one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_BUCKETS = 1 << 20
ROWS_PER_BUCKET = 1 << 17
SAMPLED = 4  # values sampled for a bucket, of which every fourth is a cut: keeps buckets alike


def with_bucket(df: DataFrame, value: str, cuts: Column, out: str = "_bucket") -> DataFrame:
    """Add the bucket of the value, the number of ``cuts.splits`` below it, by binary search in ``cuts.steps``."""
    placed = df.withColumn("_cuts", cuts)
    splits = F.col("_cuts.splits")
    found = F.aggregate(
        F.col("_cuts.steps"),
        F.lit(0),
        lambda at, s: F.when(F.get(splits, at + s - 1) < F.col(value), at + s).otherwise(at),
    )
    # never NULL, which keeps the optimizer from testing the bucket of every unmerged row
    return placed.withColumn(out, F.coalesce(found, F.lit(0))).drop("_cuts")


def value_cuts(merged: DataFrame, by: list[str], value: str, weight: str, max_buckets: int, rows_per_bucket: int) -> Column:
    """Struct of sorted split points and of the steps of a search among them: one row, one subquery.

    The splits are values sampled by hash, as many as the merged rows call for, so buckets keep their size as rows grow: no
    splits for a bucketful of rows, 8 MB of them at most. Both subqueries read the weight as well, so that their shuffle is the very
    one the rest of the plan reads.
    """
    count = merged.select(F.count(weight)).scalar()
    buckets = F.least(F.ceil(count / F.lit(rows_per_bucket)), F.lit(max_buckets))
    chance = F.shiftrightunsigned(F.xxhash64(*by, value), 11) / F.lit(float(1 << 53))
    # a condition in the aggregate, not a filter: that would move below the merge and make it another shuffle
    taken = (buckets > 1) & F.col(weight).isNotNull() & (chance * count < buckets * SAMPLED)
    sampled = merged.select(F.sort_array(F.collect_list(F.when(taken, F.col(value)))).alias("v"))
    splits = sampled.select(F.filter("v", lambda v, i: i % SAMPLED == SAMPLED - 1).alias("splits"))
    powers = F.transform(F.sequence(F.floor(F.log2(F.size("splits"))).cast("int"), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int"))
    steps = F.when(F.size("splits") > 0, powers).otherwise(F.array().cast("array<int>"))
    return splits.select(F.struct("splits", steps.alias("steps")).alias("cuts")).scalar()


def _same_keys(left: str, right: str, keys: list[str], null_safe: bool) -> Column:
    cond = F.col(f"{left}._bucket") == F.col(f"{right}._bucket")
    for k in keys:
        a, b = F.col(f"{left}.{k}"), F.col(f"{right}.{k}")
        cond = cond & (a.eqNullSafe(b) if null_safe else a == b)
    return cond


def running_weight(
    df: DataFrame,
    by: list[str],
    value: str,
    weight: str,
    thresholds: list[Callable[[Column], Column]] | None = None,
    null_keys: str = "drop",
    max_buckets: int = MAX_BUCKETS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(by, value, weight, upto, total): weight up to and including each distinct value, and the group's total.

    Rows missing the value or the weight are left out. With ``thresholds``, functions of the group's total, only the
    buckets in which the running weight first reaches one of them are sorted and returned.
    """
    if null_keys == "drop" and by:
        df = df.dropna(subset=by)
    merged = (
        df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(F.sum(weight).alias("_weight"))
    )
    cuts = value_cuts(merged, by, "_value", "_weight", max_buckets, rows_per_bucket)
    placed = with_bucket(merged, "_value", cuts)

    # one row per group and bucket from here to the join
    per_group = Window.partitionBy(*by)
    earlier = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum("_weight").alias("_in"))
        .withColumns({"_start": F.sum("_in").over(earlier), "total": F.sum("_in").over(per_group)})
    )
    if thresholds:
        wanted = F.lit(False)
        for t in thresholds:
            level = t(F.col("total"))
            reached = F.coalesce("_start", F.lit(0)) + F.col("_in") >= level
            wanted = wanted | (reached & (F.col("_start").isNull() | (F.col("_start") < level)))
        starts = starts.where(wanted)
    starts = starts.select(*by, "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"), "total")

    joined = (
        placed.alias("v")
        .join(starts.alias("s"), _same_keys("v", "s", by, null_safe=null_keys != "drop"))
        .select(*[F.col(f"v.{c}") for c in [*by, "_bucket", "_value", "_weight"]], "s._start", "s.total")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *by,
        F.col("_value").alias(value),
        F.col("_weight").alias(weight),
        (F.col("_start") + F.sum("_weight").over(inside)).alias("upto"),
        "total",
    )


def order_statistics(
    df: DataFrame, by: list[str], value: str, weight: str, thresholds: dict[str, Callable[[Column], Column]], **options
) -> DataFrame:
    """Per group and named threshold, the smallest value whose running weight reaches it; plus ``total``."""
    rows = running_weight(df, by, value, weight, list(thresholds.values()), **options)
    return rows.groupBy(*by).agg(
        F.max("total").alias("total"),
        *[F.min(F.when(F.col("upto") >= t(F.col("total")), F.col(value))).alias(name) for name, t in thresholds.items()],
    )


def quantile_thresholds(points: list[float]) -> dict[str, Callable[[Column], Column]]:
    """Ranks below and above each linear-interpolation quantile, for unit weights."""

    def at(p: float, offset: int) -> Callable[[Column], Column]:
        return lambda total: F.least(F.floor((total - 1) * F.lit(p)) + 1 + offset, total)

    return {f"{side}{i}": at(p, off) for i, p in enumerate(points) for side, off in (("lo", 0), ("hi", 1))}
