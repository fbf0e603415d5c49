import math

import numpy as np
import pytest

from popweave.llm import neighbours, queries


def brute(rows, asked, k):
    ok = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in ok:
        if asked(q):
            near = sorted((-float(np.dot(x, y)), i) for i, y in ok if i != q)[:k]
            out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("list_size", [1000, 8])
def test_small_tables_are_exact(spark, list_size, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 3)]) for i in range(60)]
    rows += [(100, None), (105, []), (110, [0.0, 0.0, 0.0]), (115, [1.0, None, 2.0]), (120, [math.nan, 1.0, 1.0]), (125, [math.inf, 1.0, 1.0])]
    rows += [(130, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])] + [(200 + i, [1.0, 2.0, 2.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS x", "3 AS list", "4 AS q")
    got = neighbours.nearest(df, lambda i: i % 5 == 0, k=7, list_size=list_size, reach=1e6)
    found = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()}
    assert found == brute(rows, lambda i: i % 5 == 0, 7)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, lambda i: i == 0, k=20, list_size=1)
    assert sorted((r["rank"], r.vec_id, r.score) for r in got.collect()) == [(1, 2, 1.0), (2, 1, 0.0)]
    assert neighbours.nearest(df.where("vec_id < 0"), lambda i: i == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), lambda i: i == 0).count() == 0


def test_graph_finds_the_nearest_centroids():
    rnd = np.random.default_rng(2)
    centroids = rnd.standard_normal((600, 16)).astype(np.float32)
    graph = neighbours.CentroidGraph(centroids)
    x = rnd.standard_normal((200, 16)).astype(np.float32)
    near, dist = graph.search(x, 40)
    exact = np.argsort(((x[:, None] - centroids) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(near[:, :40].tolist(), exact.tolist())]) > 0.95
    assert all(len({*row}) == 40 for row in near.tolist()) and (np.diff(dist, axis=1) >= 0).all()
    looked_at = graph.walk(x, 40)[2]
    assert looked_at.min() >= 40 and looked_at.mean() < 450  # of 600: the walk leaves far ones out


def test_all_lists_within_the_ratio_are_walked_to(monkeypatch):
    monkeypatch.setattr(neighbours, "BEAM", 8)
    rnd = np.random.default_rng(6)
    centroids = rnd.standard_normal((500, 4)).astype(np.float32)
    graph = neighbours.CentroidGraph(centroids)
    x = rnd.standard_normal((300, 4)).astype(np.float32)
    d = np.sqrt(((x[:, None] - centroids) ** 2).sum(axis=2))
    for ratio in (1.0, 1.5, 3.0):
        exact = [np.flatnonzero(row <= row.min() * ratio) for row in d]
        found = graph.within(x, ratio)
        assert sum(map(len, found)) <= sum(map(len, exact)) * 1.01
        assert np.mean([len({*f.tolist()} & {*e.tolist()}) / len(e) for f, e in zip(found, exact)]) > 0.97
    assert [len(f) for f in graph.within(x[:3], 1e9)] == [500] * 3


def test_ratio_is_learnt_from_the_data():
    rnd = np.random.default_rng(9)
    spots = rnd.standard_normal((40, 16)) * 5
    kinds = {"even": rnd.standard_normal((4000, 16)), "clustered": spots[rnd.integers(0, 40, 4000)] + rnd.standard_normal((4000, 16)) * 0.1}
    reach = {}
    for name, x in kinds.items():
        norm = (x**2).sum(axis=1)
        stored = np.c_[x, np.sqrt(norm.max() - norm)].astype(np.float32)
        asking = np.c_[x[:512], np.zeros(512)].astype(np.float32)
        graph = neighbours.CentroidGraph(neighbours.balanced_centroids(stored, 60))
        reach[name] = [neighbours.learnt_reach(graph, x, stored, asking, 20, 6, 0.1, r) for r in (0.5, 0.95)]
        assert 0 <= reach[name][0] <= reach[name][1]
    assert reach["clustered"][1] < reach["even"][1]


def test_lists_are_balanced():
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.standard_normal((1800, 8)) * 0.1, rnd.standard_normal((200, 8)) + 9]).astype(np.float32)
    sizes = np.bincount(neighbours._nearest_mean(x, neighbours.balanced_centroids(x, 20)), minlength=20)
    assert sizes.max() <= 4 * 100


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    got = queries.QUERIES["op8_nearest_neighbours"](spark, f"/root/testdata/{sf}").toPandas()
    found = got.groupby("query_id")["vec_id"].agg(set)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        recall.append(len({*ids[np.argsort(-scores, kind="stable")[:20]]} & found[ids[i]]) / 20)
    assert len(found) == len(recall) and np.mean(recall) >= 0.9


def test_recall_does_not_fall_with_the_number_of_lists(spark):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, lambda i: i % 300 == 0, list_size=32).toPandas()  # 938 lists, as 240,000 vectors have
    found = got.groupby("query_id")["vec_id"].agg(set)
    recall = []
    for i in range(0, len(x), 300):
        scores = x @ x[i]
        scores[i] = -np.inf
        recall.append(len({*np.argsort(-scores, kind="stable")[:20].tolist()} & found[i]) / 20)
    assert np.mean(recall) >= 0.9, np.mean(recall)


def test_rows_of_the_scan_do_not_follow_the_lists_read(spark, monkeypatch):
    rnd = np.random.default_rng(12)
    x = rnd.standard_normal((4000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scan, made = neighbours._scan, []

    def counted(*args):
        out = neighbours.cut_lineage(scan(*args))
        made.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "_scan", counted)
    got = neighbours.nearest(df, lambda i: i % 100 == 0, k=5, list_size=40, reach=1e6).collect()  # 40 queries read 100 lists
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == brute3(x, 100, 5)
    assert sum(made) < 40 * 6 * 100 / 4, made


def brute3(x, every, k):
    out = set()
    for q in range(0, len(x), every):
        scores = x @ x[q]
        scores[q] = -np.inf
        out |= {(q, r + 1, int(i), round(float(scores[i]), 9)) for r, i in enumerate(np.argsort(-scores, kind="stable")[:k])}
    return out
