"""Polygon overlay: candidate pairs on a grid, exact intersection areas, crosswalk weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions import geometry as G
from popweave.functions.numbers import number, safe_div
from popweave.functions.predicates import above_weight
from popweave.functions.text import zero_pad
from popweave.session import ship_package

BOX = ["minx", "miny", "maxx", "maxy"]
MIN_LEVEL = -30


def _levelled(boxes: DataFrame) -> DataFrame:
    """Grid level whose cell is as large as the box's longer side; boxes without any extent cannot overlap in area."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    level = F.greatest(F.ceil(F.log2(side)).cast("int"), F.lit(MIN_LEVEL))
    return boxes.withColumn("_side", side).where(F.col("_side") > 0).withColumn("_level", level).drop("_side")


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), level.cast("double"))).cast("long")


def _on_grid(boxes: DataFrame, other_levels: Column) -> DataFrame:
    """A box's cells at its own level (home) and at each coarser level the other side uses: at most four per level."""
    levels = F.concat(F.array("_level"), F.filter(F.col("_others"), lambda lv: lv > F.col("_level")))
    spread = boxes.withColumn("_others", other_levels).withColumn("_lv", F.explode(levels)).drop("_others")
    lv = F.col("_lv")
    return (
        spread.withColumn("_home", lv == F.col("_level"))
        .withColumn("_cx", F.explode(F.sequence(_cell(F.col("minx"), lv), _cell(F.col("maxx"), lv))))
        .withColumn("_cy", F.explode(F.sequence(_cell(F.col("miny"), lv), _cell(F.col("maxy"), lv))))
        .drop("_level")
    )


def candidate_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id, a box, b box) for every pair whose boxes overlap, each exactly once.

    A pair meets at the coarser of its two levels, where the larger box is at home, so dense small shapes meet in small
    cells whatever else the plane holds. Of the cells a pair shares, only the one with the lower-left corner of the
    common box keeps it. Only ids and boxes travel.
    """
    left = _levelled(a.select(F.col(a_id).alias("_a"), *BOX))
    right = _levelled(b.select(F.col(b_id).alias("_b"), *BOX))
    a_levels = left.select(F.collect_set("_level")).scalar()
    b_levels = right.select(F.collect_set("_level")).scalar()
    cells_a = _on_grid(left, b_levels).withColumnsRenamed({c: f"a_{c}" for c in [*BOX, "_home"]})
    cells_b = _on_grid(right, a_levels).withColumnsRenamed({c: f"b_{c}" for c in [*BOX, "_home"]})
    pairs = cells_a.join(cells_b, ["_lv", "_cx", "_cy"]).where(
        (F.col("a__home") | F.col("b__home"))
        & (F.col("a_minx") < F.col("b_maxx"))
        & (F.col("b_minx") < F.col("a_maxx"))
        & (F.col("a_miny") < F.col("b_maxy"))
        & (F.col("b_miny") < F.col("a_maxy"))
        & (F.col("_cx") == _cell(F.greatest("a_minx", "b_minx"), F.col("_lv")))
        & (F.col("_cy") == _cell(F.greatest("a_miny", "b_miny"), F.col("_lv")))
    )
    return pairs.select(
        F.col("_a").alias(a_id), F.col("_b").alias(b_id), *[f"a_{c}" for c in BOX], *[f"b_{c}" for c in BOX]
    )


def box_overlap_area() -> Column:
    width = F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx")
    height = F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny")
    return width * height


def overlay_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id, inter_area) of axis-parallel boxes given by minx, miny, maxx, maxy."""
    pairs = candidate_pairs(a, b, a_id, b_id)
    return pairs.select(a_id, b_id, box_overlap_area().alias("inter_area"))


def edge_list(geom: str) -> Column:
    """All edges of all rings, as structs of their two ends."""

    def ring_edges(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
        return F.zip_with(ring, nxt, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    rings = F.filter(F.flatten(F.col(geom)), lambda r: F.size(r) >= 3)
    return F.flatten(F.transform(rings, ring_edges))


# Edges of a strip: a shape of more is cut along x into strips of about as many, which are dealt over tasks.
STRIP = 4096


def in_strips(shapes: DataFrame, shape_id: str, geom: str = "geom") -> DataFrame:
    """(shape_id, _strip, minx, miny, maxx, maxy, _edges): each shape's x-ranges of about STRIP edges, one for most shapes.

    A strip holds all edges that reach into its range; the ranges of a shape meet but do not overlap, so the areas within them
    add up. Edges are sorted by their left ends once a shape; those that reach past a cut are few, and only they are looked
    at again for later strips.
    """
    at = lambda i: F.floor(i / F.lit(STRIP)).cast("int")
    right = F.transform(
        edge_list(geom),
        lambda e: F.when(e["p"]["x"] <= e["q"]["x"], e).otherwise(F.struct(e["q"].alias("p"), e["p"].alias("q"))),
    )

    def strip(i: Column, lo: Column, hi: Column, edges: Column) -> Column:
        return F.struct(i.alias("_strip"), lo.alias("minx"), hi.alias("maxx"), edges.alias("_edges"))

    def whole(edges: Column) -> Column:
        ends = F.array_min(F.transform(edges, lambda e: e["p"]["x"])), F.array_max(F.transform(edges, lambda e: e["q"]["x"]))
        return F.array(strip(F.lit(0), *ends, edges))

    def cut(edges: Column) -> Column:
        last = at(F.size(edges) - 1)
        lefts = F.transform(F.sequence(F.lit(0), last), lambda i: F.get(edges, i * STRIP)["p"]["x"])
        bounds = F.array_append(lefts, F.array_max(F.transform(edges, lambda e: e["q"]["x"])))
        return G.bind(bounds, lambda b: with_bounds(edges, b, last))

    def with_bounds(edges: Column, bounds: Column, last: Column) -> Column:
        numbered = F.transform(edges, lambda e, i: F.struct(at(i).alias("i"), e.alias("e")))
        passing = F.filter(numbered, lambda n: (n["i"] < last) & (n["e"]["q"]["x"] > F.get(bounds, n["i"] + 1)))

        def one(i: Column, long: Column) -> Column:
            earlier = F.filter(long, lambda n: (n["i"] < i) & (n["e"]["q"]["x"] > F.get(bounds, i)))
            own = F.slice(edges, i * STRIP + 1, F.lit(STRIP))
            return strip(i, F.get(bounds, i), F.get(bounds, i + 1), F.concat(own, F.transform(earlier, lambda n: n["e"])))

        return G.bind(passing, lambda long: F.transform(F.sequence(F.lit(0), last), lambda i: one(i, long)))

    parts = G.bind(right, lambda e: F.when(F.size(e) <= STRIP, whole(e)).otherwise(G.bind(F.array_sort(e), cut)))
    rows = shapes.select(shape_id, F.inline(parts)).where("minx < maxx")
    ys = F.transform("_edges", lambda e: F.least(e["p"]["y"], e["q"]["y"])), F.transform("_edges", lambda e: F.greatest(e["p"]["y"], e["q"]["y"]))
    return rows.select(shape_id, "_strip", "minx", F.array_min(ys[0]).alias("miny"), "maxx", F.array_max(ys[1]).alias("maxy"), "_edges")


def edges_between(edges: str, lo: str, hi: str) -> Column:
    """Edges that reach into an x-range, as one flat x1, y1, x2, y2 array: all that matters to areas in that range."""
    reaching = F.filter(
        edges,
        lambda e: (F.greatest(e["p"]["x"], e["q"]["x"]) > F.col(lo)) & (F.least(e["p"]["x"], e["q"]["x"]) < F.col(hi)),
    )
    return F.flatten(F.transform(reaching, lambda e: F.array(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])))


# Pairs up to this many edge combinations are worked out many at a time, larger ones each for itself.
SMALL_PAIR = 1024


def _oriented(edges: np.ndarray) -> np.ndarray:
    """Edges pointing right, so that x1 <= x2; the last axis holds x1, y1, x2, y2."""
    return np.where(edges[..., :1] > edges[..., 2:3], edges[..., [2, 3, 0, 1]], edges)


def _slopes(e: np.ndarray) -> np.ndarray:
    """Slope of each edge; vertical edges bound no area between two x, so theirs is never used."""
    run = e[..., 2] - e[..., 0]
    return np.divide(e[..., 3] - e[..., 1], run, out=np.zeros_like(run), where=run > 0)


def _crossings(a: np.ndarray, b: np.ndarray, default: np.ndarray) -> np.ndarray:
    """x of every crossing of an edge of a with an edge of b, shape (pair, a edge, b edge); the default where none."""
    slope_a, slope_b = _slopes(a)[:, :, None], _slopes(b)[:, None, :]
    ax1, ay1, ax2 = a[:, :, None, 0], a[:, :, None, 1], a[:, :, None, 2]
    bx1, by1, bx2 = b[:, None, :, 0], b[:, None, :, 1], b[:, None, :, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        # height difference at the a-edge's start, over the difference in slope
        x = ax1 + (by1 + (ax1 - bx1) * slope_b - ay1) / (slope_a - slope_b)
        inside = (x > np.maximum(ax1, bx1)) & (x < np.minimum(ax2, bx2))
    return np.where(inside, x, default[:, None, None])


def _common_length(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Length of the vertical line at each x inside both a and b, by the even-odd rule; shapes (pair, edge, 4), (pair, x)."""
    edges = np.concatenate([a, b], axis=1)
    of_a = np.arange(edges.shape[1]) < a.shape[1]
    x1, y1, x2 = (edges[:, None, :, i] for i in range(3))
    active = (x1 <= x[:, :, None]) & (x[:, :, None] < x2)
    y = np.where(active, y1 + (x[:, :, None] - x1) * _slopes(edges)[:, None, :], np.inf)
    most = int(active.sum(axis=2).max(initial=0))
    if most < 2:
        return np.zeros_like(x)
    order = np.argsort(y, axis=2, kind="stable")[:, :, :most]
    y = np.take_along_axis(y, order, axis=2)
    live = np.take_along_axis(active, order, axis=2)
    from_a = of_a[order]
    in_a = np.cumsum(live & from_a, axis=2) % 2 == 1
    in_b = np.cumsum(live & ~from_a, axis=2) % 2 == 1
    both = (in_a & in_b)[:, :, :-1] & live[:, :, 1:]
    with np.errstate(invalid="ignore"):
        return np.where(both, np.diff(y, axis=2), 0.0).sum(axis=2)


def _padded(edge_lists: list[np.ndarray], n: int) -> np.ndarray:
    """Edge lists as one array; the missing edges are points, which no line crosses."""
    out = np.zeros((len(edge_lists), n, 4))
    for i, e in enumerate(edge_lists):
        out[i, : len(e)] = e
        out[i, len(e) :] = e[0, [0, 1, 0, 1]]
    return out


def _areas_of_block(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int) -> np.ndarray:
    """Common areas, within an x-range each, of pairs with equally many (padded) edges.

    The x-axis is cut at every vertex and at every crossing. Between two cuts no edge of one crosses an edge of the other,
    so the common length along y is linear in x there, and its middle value times the width is the area.
    """
    base = a[:, 0, 1]
    shift = np.stack([lo, base, lo, base], axis=1)[:, None, :]
    a, b, hi = _oriented(a - shift), _oriented(b - shift), np.maximum(hi - lo, 0.0)
    zero = np.zeros_like(hi)
    if len(a) == 1:
        # a single large pair: edges outside the common range matter to neither cuts nor lengths
        a, b = (e[:, (e[0, :, 2] > 0) & (e[0, :, 0] < hi[0]) & (e[0, :, 0] < e[0, :, 2])] for e in (a, b))
        if hi[0] <= 0 or not a.size or not b.size:
            return zero
        step = max(1, block // b.shape[1])
        found = [_crossings(a[:, i : i + step], b, zero) for i in range(0, a.shape[1], step)]
        cuts = [np.unique(f).reshape(1, -1) for f in found]
    else:
        cuts = [_crossings(a, b, zero).reshape(len(a), -1)]
    ends = [e[:, :, i] for e in (a, b) for i in (0, 2)]
    cuts = np.sort(np.clip(np.concatenate([zero[:, None], hi[:, None], *ends, *cuts], axis=1), 0.0, hi[:, None]), axis=1)
    # edges that do not cross left a zero, sorted to the front: most columns are empty strips for every pair
    cuts = cuts[:, np.append(np.diff(cuts, axis=1).any(axis=0), True)]
    middle, width = (cuts[:, 1:] + cuts[:, :-1]) / 2, np.diff(cuts, axis=1)
    area = np.zeros_like(hi)
    step = max(1, block // (len(a) * (a.shape[1] + b.shape[1])))
    for i in range(0, middle.shape[1], step):
        area += (_common_length(a, b, middle[:, i : i + step]) * width[:, i : i + step]).sum(axis=1)
    return area


def intersection_areas(a_edges, b_edges, lo=None, hi=None, block: int = 1_000_000) -> np.ndarray:
    """Area common to each pair of polygon sets, given as flat x1, y1, x2, y2 edge lists, holes by the even-odd rule.

    ``lo`` and ``hi`` are each pair's common x-range; without them it is taken from the edges, which must then be all there.
    Pairs of similar size share one set of array operations; ``block`` bounds the elements of any one array.
    """
    a = [np.asarray(e, dtype=float).reshape(-1, 4) for e in a_edges]
    b = [np.asarray(e, dtype=float).reshape(-1, 4) for e in b_edges]
    out = np.zeros(len(a))
    if lo is None or hi is None:
        lo = [max(ea[:, [0, 2]].min(), eb[:, [0, 2]].min()) if len(ea) and len(eb) else 0.0 for ea, eb in zip(a, b)]
        hi = [min(ea[:, [0, 2]].max(), eb[:, [0, 2]].max()) if len(ea) and len(eb) else 0.0 for ea, eb in zip(a, b)]
    lo, hi = np.asarray(lo, dtype=float), np.asarray(hi, dtype=float)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (ea, eb) in enumerate(zip(a, b)):
        if len(ea) and len(eb):
            size = (1 << (len(ea) - 1).bit_length(), 1 << (len(eb) - 1).bit_length())
            groups.setdefault(size if size[0] * size[1] <= SMALL_PAIR else (0, i), []).append(i)
    for (na, nb), members in groups.items():
        if na == 0:
            i = members[0]
            out[i] = _areas_of_block(a[i][None], b[i][None], lo[[i]], hi[[i]], block)[0]
            continue
        cells = (na * nb + 2 * (na + nb) + 2) * (na + nb)
        # never one alone: a lone pair takes the other path, with the same result
        step = max(2, block // cells)
        for s in range(0, len(members), step):
            part = members[s : s + step]
            pa, pb = _padded([a[i] for i in part], na), _padded([b[i] for i in part], nb)
            out[part] = _areas_of_block(pa, pb, lo[part], hi[part], block)
    return out


def overlay(a: DataFrame, b: DataFrame, a_id: str, b_id: str, geom: str = "geom") -> DataFrame:
    """(a_id, b_id, inter_area) of every pair of shapes with a common area. Ids are unique on each side.

    Shapes of many edges take part as strips, whose areas are added up, so no task works on more than a strip of each.
    """
    ship_package(a.sparkSession)
    cut_a = in_strips(a, a_id, geom).withColumn("_sa", F.struct(a_id, "_strip"))
    cut_b = in_strips(b, b_id, geom).withColumn("_sb", F.struct(b_id, "_strip"))
    boxes = candidate_pairs(cut_a, cut_b, "_sa", "_sb")
    pairs = boxes.select(
        "_sa", "_sb", F.greatest("a_minx", "b_minx").alias("_lo"), F.least("a_maxx", "b_maxx").alias("_hi")
    )
    # Each strip's edges are attached once candidates are known, so they do not travel with every grid cell, and are cut to
    # the pair's common range at once, so only those travel on. A strip of many pairs is split by the joins' skew handling.
    with_a = pairs.join(cut_a.select("_sa", F.col("_edges").alias("_ea")), "_sa")
    with_a = with_a.withColumn("_ea", edges_between("_ea", "_lo", "_hi"))
    full = with_a.join(cut_b.select("_sb", F.col("_edges").alias("_eb")), "_sb")
    reaching = full.select(
        F.col("_sa")[a_id].alias(a_id), F.col("_sb")[b_id].alias(b_id), "_lo", "_hi", "_ea", edges_between("_eb", "_lo", "_hi").alias("_eb")
    )
    # Spread evenly just before the kernel: the work per pair is what costs, not its bytes. The number is that of other
    # shuffles, so that small rows are not put together again.
    reaching = reaching.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a_id, b_id, "_lo")

    def areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inter = intersection_areas(batch["_ea"], batch["_eb"], batch["_lo"], batch["_hi"])
            yield pd.DataFrame({a_id: batch[a_id], b_id: batch[b_id], "inter_area": inter})

    fields = {f.name: f.dataType.simpleString() for f in reaching.schema.fields}
    schema = f"`{a_id}` {fields[a_id]}, `{b_id}` {fields[b_id]}, inter_area double"
    parts = reaching.mapInPandas(areas, schema).where("inter_area > 0")
    return parts.groupBy(a_id, b_id).agg(F.sum("inter_area").alias("inter_area"))


def crosswalk_weights(
    pieces: DataFrame, source: str, source_area: str = "source_area", population: str | None = None, eps: float = 1e-9
) -> DataFrame:
    """Weight of every piece of a source area: its area fraction, or with a population its share of the source's pieces.

    The population is the same for all pieces of a source, so it cancels: the weights are the area fractions rescaled to sum
    to 1. A source whose parts sum to nothing keeps its plain fractions. With a population the parts are read twice, from one
    exchange that deals them evenly, so what made them, perhaps the overlay's kernel, runs once.
    """
    fraction = F.coalesce(safe_div(F.col("inter_area"), F.col(source_area)), F.lit(0.0))
    rows = pieces.withColumn("_fraction", fraction)
    if population is None:
        rows = rows.withColumn("weight", F.col("_fraction"))
    else:
        rows = rows.withColumn("_part", F.col("_fraction") * F.coalesce(number(pieces, population), F.lit(0.0)))
        # Both uses read every column and neither filters: so they share one exchange, whose rows lie evenly. A struct is
        # never NULL, so that the join adds no filter of its own to one side.
        dealt = rows.withColumn("_source", F.struct(source)).repartition(*pieces.columns)
        sums = dealt.groupBy("_source").agg(F.sum("_part").alias("_sum"), F.max(F.hash(*dealt.columns)).alias("_read"))
        rows = dealt.join(sums, "_source", "left").withColumn(
            "weight",
            F.when((F.col("_sum") > 0) & F.col(source).isNotNull() & F.col("_read").isNotNull(), safe_div("_part", "_sum"))
            .otherwise(F.col("_fraction")),
        )
    return rows.where(above_weight("weight", eps)).select(*pieces.columns, "weight")


def build_crosswalk(
    sources: DataFrame,
    targets: DataFrame,
    population: DataFrame | None = None,
    source_id: str = "geoid",
    target_id: str = "zip",
    geom: str = "geom",
    project: bool = True,
    eps: float = 1e-9,
) -> DataFrame:
    """(zip, tract, weight) from an overlay of source and target polygons, in the equal-area plane by default.

    ``population`` holds the source id and ``tract_pop``.
    """
    if project:
        sources = sources.withColumn(geom, G.once(G.to_equal_area(geom)))
        targets = targets.withColumn(geom, G.once(G.to_equal_area(geom)))
    pieces = overlay(sources, targets, source_id, target_id, geom)
    pieces = pieces.join(sources.select(source_id, G.area(geom).alias("source_area")), source_id, "left")
    pop = None
    if population is not None:
        pop = "tract_pop"
        pieces = pieces.join(population.select(source_id, pop), source_id, "left")
    weighted = crosswalk_weights(pieces, source_id, "source_area", pop, eps)
    return weighted.select(
        zero_pad(target_id, 5).alias("zip"), F.col(source_id).cast("string").alias("tract"), "weight"
    )


def clip_shapes(shapes: DataFrame, bbox: tuple[float, float, float, float] | None, geom: str = "geom") -> DataFrame:
    """Shapes that reach into a box, cut to it; all shapes untouched without one."""
    if not bbox:
        return shapes
    minx, miny, maxx, maxy = map(float, bbox)
    box = G.bbox(geom)
    reaches = (box["minx"] <= maxx) & (box["maxx"] >= minx) & (box["miny"] <= maxy) & (box["maxy"] >= miny)
    cut = shapes.where(reaches).withColumn(geom, G.clip_to_bbox(geom, minx, miny, maxx, maxy))
    return cut.where(F.size(geom) > 0)


def bounds(shapes: DataFrame, geom: str = "geom") -> DataFrame:
    """One row: extent of all shapes and its centre."""
    box = G.bbox(geom)
    ends = shapes.agg(
        F.min(box["minx"]).alias("minx"),
        F.min(box["miny"]).alias("miny"),
        F.max(box["maxx"]).alias("maxx"),
        F.max(box["maxy"]).alias("maxy"),
    )
    return ends.withColumns(
        {"centre_x": (F.col("minx") + F.col("maxx")) / 2, "centre_y": (F.col("miny") + F.col("maxy")) / 2}
    )
