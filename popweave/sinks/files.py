"""CSV, partitioned snapshots, GeoJSON lines and parquet artifacts. Each task writes its own file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.numbers import ColumnOrName, as_col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header; quotes are doubled, as most readers expect."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_snapshots(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> str:
    """One folder per snapshot, so that a later read of some months touches only those.

    Rows are not gathered per month: a month that holds a third of the data is written by many tasks.
    """
    df.write.mode(mode).partitionBy(*(by or ["year", "month", "flag"])).option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Reusable artifact such as a crosswalk."""
    df.write.mode(mode).parquet(path)
    return path


def geojson_geometry(geom: ColumnOrName) -> Column:
    """A geometry as a GeoJSON MultiPolygon struct."""
    coordinates = F.transform(
        as_col(geom),
        lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))),
    )
    return F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))


def feature_lines(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature per row of text; the other columns become its properties."""
    properties = F.struct(*[F.col(c) for c in df.columns if c != geom])
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), geojson_geometry(geom).alias("geometry")
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, geom: str = "geom", mode: str = "errorifexists") -> str:
    """Newline-delimited GeoJSON features."""
    feature_lines(df, geom).write.mode(mode).text(path)
    return path
