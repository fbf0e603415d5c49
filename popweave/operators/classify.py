"""Class breaks for thematic maps."""

from __future__ import annotations

import bisect
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.numbers import number
from popweave.operators.order_statistics import order_statistics, quantile_thresholds
from popweave.session import scratch_path


def map_value(df: DataFrame, col: str, null_as_zero: bool = True) -> Column:
    """The value to classify: infinite counts as missing, and missing as 0 if asked."""
    x = number(df, col)
    x = F.when(F.abs(x) < F.lit(float("inf")), x)
    return F.coalesce(x, F.lit(0.0)) if null_as_zero else x


def quantile_breaks(df: DataFrame, col: str, k: int = 6, null_as_zero: bool = True) -> DataFrame:
    """One row: ``breaks``, the distinct upper bounds of k classes of equal count, linearly interpolated and exact, and
    ``varied``, whether there are two different values at all."""
    rows = df.select(map_value(df, col, null_as_zero).alias("x"), F.lit(1).cast("long").alias("count"))
    return counted_quantile_breaks(rows, k)


def counted_quantile_breaks(rows: DataFrame, k: int) -> DataFrame:
    """As ``quantile_breaks`` over (x, count) rows."""
    points = [i / k for i in range(1, k + 1)]
    ranks = {**quantile_thresholds(points), "lowest": lambda total: F.least(total, F.lit(1))}
    found = order_statistics(rows, [], "x", "count", ranks)
    parts = []
    for i, p in enumerate(points):
        h = (F.col("total") - 1) * F.lit(p)
        parts.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (h - F.floor(h)))
    varied = F.col("lowest") < F.col(f"hi{k - 1}")
    return found.select(F.array_distinct(F.array(*parts)).alias("breaks"), varied.alias("varied"))


def approximate_quantile_breaks(df: DataFrame, col: str, k: int = 6, accuracy: int = 10000, null_as_zero: bool = True) -> DataFrame:
    """As ``quantile_breaks`` from one pass over the rows, each bound off by at most 1/accuracy of the rows."""
    points = [i / k for i in range(1, k + 1)]
    value = map_value(df, col, null_as_zero)
    return df.select(F.array_distinct(F.percentile_approx(value, points, accuracy)).alias("breaks"))


def equal_interval_breaks(df: DataFrame, col: str, k: int = 6, null_as_zero: bool = True) -> DataFrame:
    """One row: ``breaks``, the upper bounds of k classes of equal width, and ``varied``."""
    x = map_value(df, col, null_as_zero)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    inner = [F.col("lo") + (F.col("hi") - F.col("lo")) / F.lit(float(k)) * F.lit(float(i)) for i in range(1, k)]
    return ends.select(F.array(*inner, F.col("hi")).alias("breaks"), (F.col("lo") < F.col("hi")).alias("varied"))


def class_of(value: Column, breaks: list[Column]) -> Column:
    """Number of breaks below the value, so a value equal to a break belongs to the class it closes.

    A handful of comparisons rather than an array function, so that generated code does it.
    """
    return sum((F.when(b < value, 1).otherwise(0) for b in breaks), F.lit(0))


def natural_breaks(df: DataFrame, col: str, k: int = 6, null_as_zero: bool = True) -> list[float]:
    """Upper bounds of k clusters that are tight around their means.

    Starts from the quantile classes and alternates assignment and means until no value changes its cluster. Sums are exact, so the
    sum of squares within the clusters falls in every round and this ends. Rows are merged once to value and count; a round looks
    k sums up in an index and reads values only where a bound falls between two that the index does not tell apart.
    """
    merged = df.select(map_value(df, col, null_as_zero).alias("x")).where("x is not null").groupBy("x").count()
    index = PrefixSums(merged)
    k = min(k, index.values - 1)
    if k < 1:
        return []
    ranks = [(index.total - 1) * i / k for i in range(1, k)]
    ends = index.by_rank([r for h in ranks for r in (int(h) + 1, min(int(h) + 2, index.total))])
    bounds = sorted({lo + (hi - lo) * (h - int(h)) for lo, hi, h in zip(ends[::2], ends[1::2], ranks, strict=True)})
    tops: list[float] = []
    while True:
        upto = [(0, 0, None), *index.upto([*bounds, float("inf")])]
        clusters = [(n1 - n0, s1 - s0, top) for (n0, s0, _), (n1, s1, top) in zip(upto, upto[1:]) if n1 > n0]
        if [c[2] for c in clusters] == tops:
            return tops
        tops = [c[2] for c in clusters]
        means = [s / n * index.unit for n, s, _ in clusters]
        bounds = [(a + b) / 2 for a, b in zip(means, means[1:])]


class PrefixSums:
    """Count, sum and largest of the values up to any bound, over ``x`` and ``count`` rows of distinct values.

    The rows lie in a file sorted by value. The driver holds pieces of the range of values with their counts and sums: PIECES of
    equal width at first. Where a bound falls inside a piece, that piece is split further, or its values and those of the
    pieces around it are fetched, NEAR in all. Values count in units of 2^-60 of the largest, as whole numbers, so sums are exact
    and the same on any cluster.
    """

    PIECES, NEAR, HELD = 1 << 14, 1 << 15, 1 << 20

    def __init__(self, merged: DataFrame):
        spark = merged.sparkSession
        path = scratch_path(spark, "values")
        merged.repartitionByRange("x").sortWithinPartitions("x").write.parquet(path)
        self.rows = spark.read.parquet(path)
        self.values, self.total, low, high = self.rows.agg(
            F.count("*"), F.coalesce(F.sum("count"), F.lit(0)), F.min("x"), F.max("x")
        ).first()
        largest = max(abs(low or 0.0), abs(high or 0.0))
        exponent = math.frexp(largest)[1] if largest else 0
        self.unit = math.ldexp(1.0, exponent - 60)
        self.rows = self.rows.withColumn("q", (F.col("x") * F.lit(math.ldexp(1.0, 60 - exponent))).cast("bigint"))
        self._hold(self._split(low, high) if self.values else [])
        self.first = self.pieces

    def _hold(self, pieces: list[tuple]) -> None:
        """Pieces are (least, largest, count, sum, distinct values)."""
        self.pieces = pieces
        self.tops = [p[1] for p in pieces]
        self.counts = list(accumulate((p[2] for p in pieces), initial=0))
        self.sums = list(accumulate((p[3] for p in pieces), initial=0))

    def _between(self, low: float, high: float) -> DataFrame:
        return self.rows.where(F.col("x").between(low, high))

    def _split(self, low: float, high: float) -> list[tuple]:
        first, last = (int(v / self.unit) for v in (low, high))
        width = -(-(last - first + 1) // self.PIECES)
        if width == 1 and last == first:
            return self._fetch(low, high)
        place = F.floor((F.col("q") - F.lit(first)) / F.lit(width)).cast("bigint")
        part = F.col("q").cast("decimal(19,0)") * F.col("count").cast("decimal(18,0)")
        of_piece = {"low": F.min("x"), "high": F.max("x"), "n": F.sum("count"), "s": F.sum(part).cast("string"), "values": F.count("*")}
        groups = self._between(low, high).groupBy(place.alias("i"))
        table = groups.agg(*[c.alias(name) for name, c in of_piece.items()]).toArrow()
        low, high, n, s, values = (table.column(name).to_pylist() for name in of_piece)
        return sorted(zip(low, high, n, map(int, s), values, strict=True))

    def _fetch(self, low: float, high: float) -> list[tuple]:
        table = self._between(low, high).select("x", "q", "count").toArrow()
        x, q, n = (table.column(name).to_pylist() for name in ("x", "q", "count"))
        return sorted((v, v, c, u * c, 1) for v, u, c in zip(x, q, n, strict=True))

    def _refine(self, at: int) -> None:
        """Replace the piece by finer ones."""
        low, high, _, _, values = self.pieces[at]
        if len(self.pieces) > self.HELD:
            self._hold(self.first)
            return
        if values > self.NEAR:
            self._hold(self.pieces[:at] + self._split(low, high) + self.pieces[at + 1 :])
            return
        # the pieces around it that are still to be fetched, as bounds move little from round to round
        first = last = at
        while values < self.NEAR:
            around = [i for i in (first - 1, last + 1) if 0 <= i < len(self.pieces) and self.pieces[i][0] < self.pieces[i][1]]
            nearest = min(around, key=lambda i: self.pieces[i][4], default=None)
            if nearest is None or values + self.pieces[nearest][4] > self.NEAR:
                break
            values += self.pieces[nearest][4]
            first, last = min(first, nearest), max(last, nearest)
        fine = self._fetch(self.pieces[first][0], self.pieces[last][1])
        self._hold(self.pieces[:first] + fine + self.pieces[last + 1 :])

    def upto(self, bounds: list[float]) -> list[tuple]:
        """Count, sum in units, and largest, of the values that are no larger than each bound."""
        found = []
        for bound in bounds:
            while True:
                at = bisect.bisect_right(self.tops, bound)
                if at == len(self.pieces) or self.pieces[at][0] > bound:
                    break
                self._refine(at)
            found.append((self.counts[at], self.sums[at], self.tops[at - 1] if at else None))
        return found

    def by_rank(self, ranks: list[int]) -> list[float]:
        """The values at the given ranks, from 1, each counting as often as it occurs."""
        found = []
        for rank in ranks:
            while True:
                at = bisect.bisect_left(self.counts, rank) - 1
                if self.pieces[at][0] == self.pieces[at][1]:
                    break
                self._refine(at)
            found.append(self.tops[at])
        return found


def distinct_values(df: DataFrame, col: str, null_as_zero: bool = True) -> DataFrame:
    return df.select(F.count_distinct(map_value(df, col, null_as_zero)).alias("n_distinct"))


def classify(
    df: DataFrame, col: str, scheme: str = "quantiles", k: int = 6, out: str = "class", null_as_zero: bool = True
) -> DataFrame:
    """Add the class id of each value; NULL for all when the column has at most one distinct value."""
    scheme = scheme.lower()
    if scheme in ("naturalbreaks", "jenks", "fisherjenks", "nb"):
        bounds = natural_breaks(df, col, k, null_as_zero)
        if not bounds:
            return df.withColumn(out, F.lit(None).cast("int"))
        x = map_value(df, col, null_as_zero)
        return df.withColumn(out, F.when(x.isNotNull(), class_of(x, [F.lit(b) for b in bounds])))
    find = equal_interval_breaks if scheme in ("equal", "equalinterval") else quantile_breaks
    found = find(df, col, k, null_as_zero).select(F.struct("breaks", "varied").alias("found")).scalar()
    placed = df.withColumn("_found", found)
    value, breaks = map_value(placed, col, null_as_zero), F.col("_found.breaks")
    return placed.withColumn(
        out,
        F.when(F.col("_found.varied") & value.isNotNull(), class_of(value, [F.get(breaks, F.lit(i)) for i in range(k)])),
    ).drop("_found")
