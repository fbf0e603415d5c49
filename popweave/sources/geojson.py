"""GeoJSON features as properties plus a polygon column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from popweave.functions.geometry import GEOMETRY, point

# coordinates stay text here; their nesting depends on the geometry type
PART = StructType([StructField("type", StringType()), StructField("coordinates", StringType())])
FEATURE = StructType(
    [
        StructField("properties", MapType(StringType(), StringType())),
        StructField("geometry", StructType([*PART.fields, StructField("geometries", ArrayType(PART))])),
    ]
)


def polygons_from_coordinates(kind: Column, coordinates: Column) -> Column:
    """Polygon and MultiPolygon coordinates as one geometry type; other types are NULL."""

    def points(poly: Column) -> Column:
        return F.transform(
            poly,
            lambda ring: F.transform(ring, lambda xy: point(F.get(xy, F.lit(0)), F.get(xy, F.lit(1)))),
        )

    single = F.array(points(F.from_json(coordinates, "array<array<array<double>>>")))
    multi = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), points)
    return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi).otherwise(F.lit(None).cast(GEOMETRY))


def polygons_of(geometry: Column) -> Column:
    """Polygons of a geometry; of a collection those of all its polygon members. NULL when it has none."""
    members = F.filter(geometry["geometries"], lambda g: g["type"].isin("Polygon", "MultiPolygon"))
    together = F.flatten(F.transform(members, lambda g: polygons_from_coordinates(g["type"], g["coordinates"])))
    own = polygons_from_coordinates(geometry["type"], geometry["coordinates"])
    return F.when((geometry["type"] == "GeometryCollection") & (F.size(members) > 0), together).otherwise(own)


def features(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Parse one GeoJSON feature per row of text."""
    parsed = df.select(*(keep or []), F.from_json(F.col(text), FEATURE).alias("_f"))
    return parsed.select(
        *(keep or []),
        F.col("_f.properties").alias("properties"),
        polygons_of(F.col("_f.geometry")).alias("geom"),
    )


def scan_geojson(spark: SparkSession, path: str | list[str], layout: str = "collection_files") -> DataFrame:
    """(properties, geom) rows of FeatureCollections, one to a file or to a line, or of one feature to a line.

    A FeatureCollection is one JSON value, so a file that holds one is parsed by one task, which holds all its features: meant for
    files of up to some hundred megabytes, many of which are read side by side. The line layouts split.
    """
    if layout not in ("collection_files", "collection_lines", "feature_lines"):
        raise ValueError(f"unknown layout {layout}")
    if layout == "feature_lines":
        return features(spark.read.text(path), "value")
    collection = StructType([StructField("features", ArrayType(FEATURE))])
    whole_files = layout == "collection_files"
    rows = spark.read.schema(collection).option("multiLine", whole_files).json(path).select(F.inline("features"))
    return rows.select("properties", polygons_of(F.col("geometry")).alias("geom"))


def feature_ids(shapes: DataFrame, candidates: list[str], name: str, width: int | None = None) -> DataFrame:
    """Add the first of the candidate properties that a feature has, zero-padded if a width is given."""
    from popweave.functions.text import zero_pad

    value = F.coalesce(*[F.try_element_at("properties", F.lit(c)) for c in candidates])
    return shapes.withColumn(name, zero_pad(value, width) if width else value)
