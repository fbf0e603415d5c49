"""Estimates carried to map areas, and the tables behind maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popweave.functions.numbers import coefficient_of_variation, number
from popweave.functions.text import zero_pad
from popweave.operators.apportion import apportion, rollup_nested
from popweave.operators.classify import classify
from popweave.operators.joins import join_preferring_right
from popweave.operators.overlay import bounds, build_crosswalk, clip_shapes


def estimates_by_zip(
    stats: DataFrame,
    crosswalk: DataFrame | None = None,
    source_shapes: DataFrame | None = None,
    target_shapes: DataFrame | None = None,
    population: DataFrame | None = None,
    key_digits: int | None = None,
) -> DataFrame:
    """Area estimates apportioned to targets through a published crosswalk, or through one built by overlay."""
    if crosswalk is None:
        if source_shapes is None or target_shapes is None:
            raise ValueError("needs a crosswalk, or the shapes to build one")
        crosswalk = build_crosswalk(source_shapes, target_shapes, population)
        key_digits = key_digits or 11
    return apportion(stats, crosswalk, key_digits)


def estimates_by_neighbourhood(stats: DataFrame, nesting: DataFrame, key_digits: int | None = None) -> DataFrame:
    return rollup_nested(stats, nesting, key_digits)


def with_shapes(estimates: DataFrame, shapes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shapes of the areas that have an estimate; joined on the named keys, or on all id columns both sides share."""
    keys = keys or [c for c in ("zip", "nta", "ntaname") if c in estimates.columns and c in shapes.columns]
    return shapes.join(estimates, keys, "inner")


def with_cv(table: DataFrame) -> DataFrame:
    """Add the coefficient of variation unless the table brings one."""
    if "cv" in table.columns or not {"estimate", "moe"} <= set(table.columns):
        return table
    return table.withColumn("cv", coefficient_of_variation(number(table, "estimate"), number(table, "moe")))


def map_table(
    values: DataFrame,
    shapes: DataFrame,
    key: str = "zip",
    column: str = "estimate",
    scheme: str = "quantiles",
    k: int = 6,
    bbox: tuple[float, float, float, float] | None = None,
    width: int | None = 5,
) -> DataFrame:
    """One row per mapped area: values, cv, class and shape, clipped to a box if given.

    Where both sides hold a column, the values' side counts unless it is missing there.
    """
    keyed = values.withColumn(key, zero_pad(key, width)) if width else values
    joined = with_cv(join_preferring_right(shapes, with_cv(keyed), [key], "inner"))
    return classify(clip_shapes(joined, bbox), column, scheme, k)


def map_extent(table: DataFrame) -> DataFrame:
    """Extent and centre of the mapped shapes."""
    return bounds(table.where(F.col("geom").isNotNull()))
