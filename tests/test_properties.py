"""Operators against brute force, with buckets forced small so that the many-bucket path runs."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import rows
from popweave.functions import codes as C, geometry as G
from popweave.operators import apportion as A, classify as K, overlay as V
from popweave.operators import joins
from popweave.operators.joins import likely_members
from popweave.operators.order_statistics import order_statistics, quantile_thresholds, running_weight, value_cuts, with_bucket

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
records = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "b", None]), st.integers(-20, 20), st.integers(0, 5)), min_size=1, max_size=60
)


def brute_median(pairs):
    total, upto = sum(w for _, w in pairs), 0
    for x, w in sorted(pairs):
        upto += w
        if 2 * upto >= total:
            return float(x)


@pytest.mark.parametrize("keys", ["drop", "keep"])
@FEW
@given(data=records)
def test_weighted_median(spark, data, keys):
    df = spark.createDataFrame([(g, float(x), w) for g, x, w in data], "g string, x double, w long")
    found = order_statistics(df, ["g"], "x", "w", {"m": lambda t: t / 2}, null_keys=keys, max_buckets=16, rows_per_bucket=1)
    groups = {g for g, _, _ in data if g is not None or keys == "keep"}
    expected = {g: brute_median([(x, w) for h, x, w in data if h == g]) for g in groups}
    assert {r["g"]: r["m"] for r in found.collect()} == expected


def test_running_weight_over_many_buckets(spark):
    rng = np.random.default_rng(5)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.integers(4)}", float(rng.integers(0, 500)), int(rng.integers(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, x double, w long")
    got = running_weight(df, ["g"], "x", "w", max_buckets=64, rows_per_bucket=10)
    merged = {}
    for g, x, w in data:
        merged.setdefault(g, {}).setdefault(x, 0)
        merged[g][x] += w
    expected = []
    for g, values in merged.items():
        upto = 0
        for x in sorted(values):
            upto += values[x]
            expected.append((g, x, values[x], upto, sum(values.values())))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_match_linear_interpolation(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(size=n), 3)
    df = spark.createDataFrame([(float(v), 1) for v in x], "x double, n long")
    points = [i / 6 for i in range(1, 7)]
    r = order_statistics(df, [], "x", "n", quantile_thresholds(points), max_buckets=32, rows_per_bucket=3).first()
    for i, p in enumerate(points):
        h = (n - 1) * p
        value = r[f"lo{i}"] + (r[f"hi{i}"] - r[f"lo{i}"]) * (h - math.floor(h))
        assert value == pytest.approx(np.quantile(x, p), abs=1e-12)
    breaks = K.quantile_breaks(df, "x", 6).first()["breaks"]
    assert breaks == pytest.approx(sorted({float(q) for q in np.quantile(x, points)}), abs=1e-12)


def within(values, classes):
    return sum(((values[classes == c] - values[classes == c].mean()) ** 2).sum() for c in np.unique(classes))


def test_natural_breaks_are_stable_and_no_worse_than_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, 80) for c in (0, 6, 30)]).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    breaks = K.natural_breaks(df, "x", 3)
    classes = np.searchsorted(breaks, x)
    even = np.searchsorted(np.quantile(x, [1 / 3, 2 / 3, 1]), x)
    assert within(x, classes) <= within(x, even) + 1e-9
    assert len(breaks) == 3 and breaks[-1] == x.max() and breaks == K.natural_breaks(df, "x", 3)
    # each value is nearest to its own cluster's mean
    means = np.array([x[classes == c].mean() for c in range(3)])
    assert (np.abs(x[:, None] - means).argmin(axis=1) == classes).all()


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 15, 1 << 20), (8, 30, 200)])
def test_natural_breaks_equal_plain_rounds(spark, monkeypatch, sizes):
    """Whatever the pieces of the index: the same bounds as rounds over all values with exact sums."""
    for name, size in zip(("PIECES", "NEAR", "HELD"), sizes):
        monkeypatch.setattr(K.PrefixSums, name, size)
    rng = np.random.default_rng(8)
    for x in (rng.integers(0, 50, 120) / 4, np.r_[rng.normal(0, 1, 60).round(1), 1e6, -1e6, 1e-3], np.array([2.0, 2.0, 5.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        k = min(4, len(set(x)) - 1)
        bounds = sorted(set(np.quantile(x, [i / k for i in range(1, k)])))
        tops = None
        while True:
            c = np.searchsorted(bounds, x)
            found = [max(x[c == i]) for i in sorted(set(c))]
            if found == tops:
                break
            tops = found
            means = [float(sum(map(Fraction, x[c == i])) / int((c == i).sum())) for i in sorted(set(c))]
            bounds = [(a + b) / 2 for a, b in zip(means, means[1:])]
        assert K.natural_breaks(df, "x", 4) == tops


def test_long_code_lists_are_searched(spark):
    codes = {f"k{i * 7 % 10_000}é": f"label {i}" for i in range(10_000)} | {"": "empty", "~": "last"}
    asked = [("k0é",), ("k9999é",), ("k10000é",), ("",), ("~",), ("~~",), (None,), ("K0é",)]
    df = spark.createDataFrame(asked, "c string")
    got = {r.c: r.l for r in df.select("c", C.lookup("c", codes).alias("l")).collect()}
    assert got == {c: codes.get(c) for (c,) in asked}


def test_classes(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (0.0,), (4.0,), (10.0,)], "v double")
    got = {r["v"]: r["class"] for r in K.classify(df, "v", "equal", 5).collect()}
    assert got == {None: 0, float("inf"): 0, 0.0: 0, 4.0: 1, 10.0: 4}
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    for scheme in ("quantiles", "equal", "jenks"):
        assert [r["class"] for r in K.classify(same, "v", scheme, 4).collect()] == [None, None]


# --- polygons ---------------------------------------------------------------------------------------------------


def edges(*rings):
    return np.concatenate([np.c_[np.array(r, float), np.roll(np.array(r, float), -1, axis=0)] for r in rings]).ravel()


def shoelace(p):
    p = np.array(p, float)
    q = np.roll(p, -1, axis=0)
    return 0.5 * abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())


def convex_clip(subject, clip):
    """Area of a polygon clipped by a convex counter-clockwise one, edge by edge."""
    out = [np.array(p, float) for p in subject]
    for a, b in zip(np.array(clip, float), np.roll(np.array(clip, float), -1, axis=0)):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        nxt = []
        for i, p in enumerate(out):
            q, sp, sq = out[(i + 1) % len(out)], side[i], side[(i + 1) % len(out)]
            if sp >= 0:
                nxt.append(p)
            if sp * sq < 0:
                nxt.append(p + (q - p) * sp / (sp - sq))
        out = nxt
        if not out:
            return 0.0
    return shoelace(out)


def regular(n, cx, cy, r, turn=0.0):
    t = np.linspace(0, 2 * math.pi, n, endpoint=False) + turn
    return np.c_[cx + r * np.cos(t), cy + r * np.sin(t)]


def test_convex_intersections_match_clipping():
    rng = np.random.default_rng(0)
    a, b, expected = [], [], []
    for _ in range(300):
        p = regular(rng.integers(3, 9), *rng.normal(size=2), rng.uniform(0.3, 2), rng.uniform(0, 6))
        q = regular(rng.integers(3, 9), *rng.normal(size=2), rng.uniform(0.3, 2), rng.uniform(0, 6))
        a.append(edges(p))
        b.append(edges(q[::-1] if rng.random() < 0.5 else q))
        expected.append(convex_clip(p, q))
    many = V.intersection_areas(a, b)
    assert many == pytest.approx(expected, abs=1e-9)
    assert V.intersection_areas(b, a) == pytest.approx(many, abs=1e-9)
    # the path for a lone pair, and blocks that hold a few elements only
    assert [V.intersection_areas([x], [y])[0] for x, y in zip(a[:40], b[:40])] == pytest.approx(many[:40], abs=1e-12)
    assert V.intersection_areas(a, b, block=50) == pytest.approx(many, abs=1e-12)


def test_concave_holes_and_shared_edges():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    cases = [
        (edges(square), edges(square), 16),
        (edges(square, hole), edges(square), 12),
        (edges(square, hole), edges(hole[::-1]), 0),
        (edges(square, hole), edges(ell), 7),
        (edges(ell), edges([(x + 4, y) for x, y in square]), 0),
        (edges(ell), edges([(0.5, 0.5), (9, 0.5), (9, 9), (0.5, 9)]), 0.5 * 0.5 + 3 * 0.5 + 3 * 0.5),
        (edges(square), edges([(9, 9), (10, 9), (10, 10)]), 0),
        (edges(square, [(8, 0), (9, 0), (9, 9)]), edges([(-1, -1), (20, -1), (20, 20), (-1, 20)]), 16 + 4.5),
    ]
    for a, b, expected in cases:
        assert V.intersection_areas([a], [b])[0] == pytest.approx(expected, abs=1e-9)
    assert V.intersection_areas(*zip(*[c[:2] for c in cases])) == pytest.approx([c[2] for c in cases], abs=1e-9)


def test_large_rings():
    t = np.linspace(0, 2 * math.pi, 1500, endpoint=False)
    r = 1 + 0.3 * np.sin(9 * t)
    star = np.c_[r * np.cos(t), r * np.sin(t)]
    assert V.intersection_areas([edges(star)], [edges(star)])[0] == pytest.approx(shoelace(star), rel=1e-12)
    half = [(0, -9), (9, -9), (9, 9), (0, 9)]
    assert V.intersection_areas([edges(star)], [edges(half)])[0] == pytest.approx(convex_clip(star, half), rel=1e-9)


def shapes(spark, name, polygons):
    data = [(i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in poly] for poly in geom]) for i, geom in polygons]
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.createDataFrame(data, StructType([StructField(name, LongType()), StructField("geom", G.GEOMETRY)]))


def test_candidates_meet_once_across_sizes(spark):
    rng = np.random.default_rng(8)

    def boxes(n, name):
        # sizes over six orders of magnitude, a third of all boxes in one spot, some without extent
        out = []
        for i in range(n):
            c = (0.1, 0.1) if i % 3 == 0 else rng.uniform(-50, 50, 2)
            s = 10 ** rng.uniform(-4, 2, 2) if i % 20 else (0.0, 0.0)
            out.append((i, float(c[0] - s[0]), float(c[1] - s[1]), float(c[0] + s[0]), float(c[1] + s[1])))
        return out, spark.createDataFrame(out, f"{name} long, minx double, miny double, maxx double, maxy double")

    (la, a), (lb, b) = boxes(150, "a"), boxes(200, "b")
    expected = sorted(
        (p[0], q[0]) for p in la for q in lb if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
        and max(p[3] - p[1], p[4] - p[2]) > 0 and max(q[3] - q[1], q[4] - q[2]) > 0
    )
    got = V.candidate_pairs(a, b, "a", "b").select("a", "b").collect()
    assert sorted(tuple(r) for r in got) == expected


def test_crosswalk_conserves_totals(spark):
    """A 3 x 3 grid of sources, fully covered by two targets and a hole-free strip; population as well as area weights."""
    sources = [(i * 3 + j, [[[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]]]) for i in range(3) for j in range(3)]
    targets = [(1, [[[(0, 0), (3, 0), (0, 3)]]]), (2, [[[(3, 0), (3, 3), (0, 3)]]]), (3, [[[(8, 8), (9, 8), (9, 9)]]])]
    a, b = shapes(spark, "geoid", sources), shapes(spark, "zip", targets)
    pop = spark.createDataFrame([(i, float(i % 4)) for i in range(8)], "geoid long, tract_pop double")
    for population in (None, pop):
        made = V.build_crosswalk(a, b, population, project=False).cache()
        sums = made.groupBy("tract").agg(F.sum("weight").alias("w")).collect()
        assert len(sums) == 9 and all(r["w"] == pytest.approx(1) for r in sums)
        assert {r["zip"] for r in made.select("zip").collect()} == {"00001", "00002"}
        stats = spark.createDataFrame([(str(i), float(i + 1), 1.0) for i in range(9)], "geoid string, estimate double, moe double")
        out = A.apportion(stats, made, key_digits=11, rounded=False).collect()
        assert sum(r["estimate"] for r in out) == pytest.approx(45)
        assert all(r["moe"] <= 9 for r in out)


def test_partly_covered_source_keeps_its_fraction(spark):
    a = shapes(spark, "geoid", [(1, [[[(0, 0), (2, 0), (2, 2), (0, 2)]]])])
    b = shapes(spark, "zip", [(7, [[[(1, 0), (5, 0), (5, 2), (1, 2)]]])])
    assert rows(V.build_crosswalk(a, b, project=False)) == [("00007", "1", 0.5)]
    nobody = spark.createDataFrame([(1, 0.0)], "geoid long, tract_pop double")
    assert rows(V.build_crosswalk(a, b, nobody, project=False)) == [("00007", "1", 0.5)]
    some = spark.createDataFrame([(1, 9.0)], "geoid long, tract_pop double")
    assert rows(V.build_crosswalk(a, b, some, project=False)) == [("00007", "1", 1.0)]


def test_clip_matches_overlay_area(spark):
    star = [(0, 3), (1, 1), (3, 0), (1, -1), (0, -3), (-1, -1), (-3, 0), (-1, 1), (0, 3)]
    a = shapes(spark, "i", [(1, [[star]]), (2, [[[(5, 5), (6, 5), (6, 6)]]]), (3, [[[(-2, -2), (2, -2), (2, 2), (-2, 2)], [(-1, -1), (-1, 1), (1, 1), (1, -1)]]])])
    box = (-0.5, -2.0, 2.5, 0.75)
    got = {r["i"]: r["area"] for r in V.clip_shapes(a, box).select("i", G.area("geom").alias("area")).collect()}
    clip = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
    assert set(got) == {1, 3}
    assert got[1] == pytest.approx(convex_clip(star[:-1], clip))
    assert got[3] == pytest.approx((2 + 0.5) * 2.75 - 1.5 * 1.75)
    assert V.clip_shapes(a, None).count() == 3


def test_projection_known_point(spark):
    """The projection's origin is (0, 0), and area is kept: one square degree against the ellipsoid's own area."""
    origin = shapes(spark, "i", [(1, [[[(-96, 23)]]])]).select(F.flatten(F.flatten(G.to_equal_area("geom"))).alias("p")).first()["p"][0]
    assert abs(origin["x"]) < 1e-6 and abs(origin["y"]) < 1e-6
    fine = [(-75 + i / 200, 40) for i in range(201)] + [(-74 - i / 200, 41) for i in range(201)]
    area = shapes(spark, "i", [(1, [[fine]])]).select(G.area(G.to_equal_area("geom"))).first()[0]
    e2 = 2 / G.INVERSE_FLATTENING - 1 / G.INVERSE_FLATTENING**2
    e = math.sqrt(e2)

    def q(lat):
        s = math.sin(math.radians(lat))
        return s / (1 - e2 * s * s) + math.atanh(e * s) / e

    exact = G.SEMI_MAJOR**2 * (1 - e2) / 2 * math.radians(1) * (q(41) - q(40))
    assert area == pytest.approx(exact, rel=1e-6)


def star(n, x, y, r, spikes, wave=0.3):
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    r = r * (1 + wave * np.sin(spikes * t))
    return np.c_[x + r * np.cos(t), y + r * np.sin(t)]


def test_strips_add_up_to_whole_shapes(spark, monkeypatch):
    rng = np.random.default_rng(17)
    sides = []
    for name in ("a", "b"):
        made = []
        for i in range(12):
            x, y = rng.uniform(-2, 2, 2)
            n = int(rng.integers(40, 400)) if i % 3 else 5
            poly = [star(n, x, y, 1.5, 7), star(max(n // 2, 3), x, y, 0.5, 3)]  # with a hole
            made.append((i, [poly, [star(30, x + 5, y, 0.8, 5)]]))
        sides.append(shapes(spark, name, made))
    found = []
    for strip in (1 << 20, 16):
        monkeypatch.setattr(V, "STRIP", strip)
        found.append({(r.a, r.b): r.inter_area for r in V.overlay(*sides, "a", "b").collect()})
    assert len(found[0]) > 50 and found[1] == pytest.approx(found[0], rel=1e-9, abs=1e-12)
    strips = V.in_strips(sides[0], "a").groupBy("a").agg(F.count("*").alias("n"), F.max(F.size("_edges")).alias("most"))
    assert {r.n > 1 for r in strips.collect()} == {True} and max(r.most for r in strips.collect()) < 60


def test_a_shape_of_very_many_edges(spark):
    n = 200_000
    t = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * (2 * math.pi / n))
    ring = F.transform(t, lambda v: G.point((1 + 0.3 * F.sin(v * 9)) * F.cos(v), (1 + 0.3 * F.sin(v * 9)) * F.sin(v)))
    a = spark.range(1).select(F.col("id").alias("a"), F.array(F.array(ring)).alias("geom"))
    b = shapes(spark, "b", [(0, [[[(0, -9), (9, -9), (9, 9), (0, 9)]]]), (1, [[[(-9, -9), (0, -9), (0, 9), (-9, 9)]]])])
    assert V.in_strips(a, "a").agg(F.max(F.size("_edges"))).first()[0] < 2 * V.STRIP
    found = {r.b: r.inter_area for r in V.overlay(a, b, "a", "b").collect()}
    whole = star(n, 0, 0, 1, 9)
    half = [(0, -9), (9, -9), (9, 9), (0, 9)]
    assert found[0] == pytest.approx(convex_clip(whole, half), rel=1e-9)
    assert sum(found.values()) == pytest.approx(shoelace(whole), rel=1e-9)


@pytest.mark.parametrize("rows_per_bucket, most, expected", [(1 << 17, 1 << 20, 1), (100, 1 << 20, 200), (10, 1 << 20, 2000), (10, 64, 64)])
def test_buckets_follow_the_merged_rows(spark, rows_per_bucket, most, expected):
    merged = spark.range(20_000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v", "1 AS w").groupBy("g", "v").agg(F.sum("w").alias("w"))
    cuts = value_cuts(merged, ["g"], "v", "w", most, rows_per_bucket)
    sizes = [r["count"] for r in with_bucket(merged, "v", cuts).groupBy("_bucket").count().collect()]
    assert sum(sizes) == 20_000 and 0.8 * expected <= len(sizes) <= 1.2 * expected
    assert max(sizes) <= 6 * max(20_000 / expected, 1)


def test_likely_members(spark):
    members = spark.createDataFrame([(f"u{i * 37}",) for i in range(300)] + [(None,)], "k string")
    df = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("k")).union(members.where("k is null"))
    kept = likely_members(df, "k", members)
    assert kept.join(members, "k", "left_semi").count() == 300 and kept.count() < 320
    assert kept.where("k is null").count() == 0
    assert likely_members(df, "k", members.limit(0)).count() == 0
    few = likely_members(df, "k", members, bits=1 << 10)
    assert few.join(members, "k", "left_semi").count() == 300 and few.count() < 10_000


@pytest.mark.parametrize("bits", [1 << 23, 16])
def test_without_members(spark, monkeypatch, bits):
    monkeypatch.setattr(joins.likely_member, "__defaults__", (None, bits))
    df = spark.createDataFrame([(i, i % 50) for i in range(100)] + [(None, 7)], "v int, k int").select("v", F.when(F.col("v").isNotNull(), F.col("k")).alias("k"))
    kept = joins.without_members(df, "k", spark.createDataFrame([(k,) for k in (3, 3, 9, None, 70)], "k int"))
    assert kept.columns == ["v", "k"]
    expected = [(i, i % 50) for i in range(100) if i % 50 not in (3, 9)] + [(None, None)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(expected, key=str)
    assert joins.without_members(df, "k", spark.createDataFrame([], "k int")).count() == 101
