"""Polygons as ``array<polygon>``, polygon = ``array<ring>``, ring = ``array<struct<x,y>>``.

The first ring of a polygon is its outline, the others are holes, whatever their orientation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from popweave.functions.numbers import ColumnOrName, as_col

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
GEOMETRY = ArrayType(ArrayType(ArrayType(POINT)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def bind(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(value: Column) -> Column:
    """A column that is worked out once a row, however many later columns use it: the planner does not copy it into them."""
    return F.explode(F.array(value))


def box_polygon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """An axis-parallel rectangle as a geometry."""
    ring = F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))
    return F.array(F.array(ring))


def map_points(geom: ColumnOrName, f) -> Column:
    """Apply a point function to every vertex."""
    return F.transform(as_col(geom), lambda poly: F.transform(poly, lambda ring: F.transform(ring, f)))


def _next_points(ring: Column) -> Column:
    """The ring rotated by one vertex, so that ``zip_with`` sees its edges, closed or not."""
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area, taken from the ring's first vertex to keep digits."""
    origin = F.get(ring, F.lit(0))
    cross = F.zip_with(
        ring,
        _next_points(ring),
        lambda p, q: (p["x"] - origin["x"]) * (q["y"] - origin["y"]) - (q["x"] - origin["x"]) * (p["y"] - origin["y"]),
    )
    return F.when(
        F.size(ring) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2
    ).otherwise(F.lit(0.0))


def area(geom: ColumnOrName) -> Column:
    """Area of all polygons, outlines minus holes."""

    def polygon_area(poly: Column) -> Column:
        signed = F.transform(poly, lambda ring, i: F.when(i == 0, ring_area(ring)).otherwise(-ring_area(ring)))
        return F.aggregate(signed, F.lit(0.0), lambda acc, v: acc + v)

    return F.aggregate(F.transform(as_col(geom), polygon_area), F.lit(0.0), lambda acc, v: acc + v)


def bbox(geom: ColumnOrName) -> dict[str, Column]:
    """minx, miny, maxx, maxy of one geometry."""
    points = F.flatten(F.flatten(as_col(geom)))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def clip_to_bbox(geom: ColumnOrName, minx, miny, maxx, maxy) -> Column:
    """Clip every ring against the four half-planes of a box; rings that vanish are dropped."""
    limits = [F.lit(float(v)) if isinstance(v, (int, float)) else as_col(v) for v in (minx, miny, maxx, maxy)]

    def half_plane(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"

        def inside(p: Column) -> Column:
            return p[axis] >= limit if keep_above else p[axis] <= limit

        def cut(p: Column, q: Column) -> Column:
            t = (limit - p[axis]) / (q[axis] - p[axis])
            along = p[other] + t * (q[other] - p[other])
            return point(limit, along) if axis == "x" else point(along, limit)

        def edge(p: Column, q: Column) -> Column:
            return (
                F.when(inside(p) & inside(q), F.array(q))
                .when(inside(p), F.array(cut(p, q)))
                .when(inside(q), F.array(cut(p, q), q))
                .otherwise(F.array().cast(ArrayType(POINT)))
            )

        return F.flatten(F.zip_with(ring, _next_points(ring), edge))

    def clip_ring(ring: Column) -> Column:
        for axis, limit, keep_above in (("x", 0, True), ("x", 2, False), ("y", 1, True), ("y", 3, False)):
            ring = bind(ring, lambda r: half_plane(r, axis, limits[limit], keep_above))
        return ring

    def open_ring(ring: Column) -> Column:
        """Without the closing vertex, whose zero-length edge carries nothing."""
        closed = (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1))
        return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    def clip_polygon(poly: Column) -> Column:
        return bind(F.transform(poly, lambda ring: clip_ring(open_ring(ring))), without_lost_rings)

    def without_lost_rings(rings: Column) -> Column:
        """A polygon whose outline vanished is gone with its holes; otherwise only the vanished holes are."""
        outline = F.get(rings, F.lit(0))
        return F.when(F.size(outline) >= 3, F.filter(rings, lambda r: F.size(r) >= 3)).otherwise(
            F.array().cast(ArrayType(ArrayType(POINT)))
        )

    return F.filter(F.transform(as_col(geom), clip_polygon), lambda poly: F.size(poly) > 0)


# GRS80 ellipsoid and the parameters of the conterminous-US equal-area projection (EPSG 5070).
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
LAT_ORIGIN, LON_ORIGIN, PARALLEL_1, PARALLEL_2 = 23.0, -96.0, 29.5, 45.5


def _albers_constants() -> dict[str, float]:
    """Constants of the ellipsoidal Albers projection (Snyder 1987, eq. 14-3 to 14-19), m of the parallels as its square."""
    f = 1 / INVERSE_FLATTENING
    e = math.sqrt(2 * f - f * f)

    def m_squared(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) ** 2 / (1 - (e * s) ** 2)

    def q(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    n = (m_squared(PARALLEL_1) - m_squared(PARALLEL_2)) / (q(PARALLEL_2) - q(PARALLEL_1))
    c = m_squared(PARALLEL_1) + n * q(PARALLEL_1)
    return {"e": e, "n": n, "c": c, "rho0": SEMI_MAJOR * math.sqrt(c - n * q(LAT_ORIGIN)) / n}


ALBERS = _albers_constants()


def albers_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to equal-area metres."""
    e, n, c, rho0 = ALBERS["e"], ALBERS["n"], ALBERS["c"], ALBERS["rho0"]
    s = F.sin(F.radians(lat))
    es = F.lit(e) * s
    q = F.lit(1 - e * e) * (s / (F.lit(1.0) - es * es) - F.log((F.lit(1.0) - es) / (F.lit(1.0) + es)) / F.lit(2 * e))
    rho = F.lit(SEMI_MAJOR / n) * F.sqrt(F.lit(c) - F.lit(n) * q)
    theta = F.lit(n) * F.radians(lon - F.lit(LON_ORIGIN))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def to_equal_area(geom: ColumnOrName) -> Column:
    """Reproject a longitude/latitude geometry to the equal-area plane."""
    return map_points(geom, lambda p: point(*albers_xy(p["x"], p["y"])))
