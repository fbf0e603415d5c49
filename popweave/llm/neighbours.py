"""Approximate nearest neighbours by inner product over balanced posting lists.

Centroids are the means of parts of a sample that are kept at like sizes, so lists are balanced. Every vector goes to its
nearest list and, near a border, to others whose centroid is nearly as close. A graph over the centroids, small enough for
each worker's memory, is walked to find a vector's lists as well as a query's. A query reads the lists whose distance is within
a ratio of the nearest one's, in rounds: the nearest one first, then ROUNDS times as many each time, and of what a list holds
only vectors that are no farther than the best found so far come back. The ratio is learnt: the one at which sampled vectors, asked against the sample, reach the lists of
nearly all their nearest. Vectors get one more component that makes inner-product order Euclidean order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from popweave.session import cut_lineage, ship_package

SAMPLE = 65_536  # rows that the centroids are fitted on, at most
CELLS = 1 << 24  # components of those rows together, at most
LISTS = 16_384  # centroids, at most: what is broadcast does not grow past this
BLOCK = 4_096  # vectors, or queries, of one list that meet in one task
BEAM = 128  # centroids that a walk keeps in view, at least
STEP = 8  # of them, those whose links are followed at a time
ROUNDS = 8  # times as many lists as before it are read in a round
ASKED = 512  # sampled vectors that the ratio is learnt from


class CentroidGraph:
    """Centroids and, for each, near ones in differing directions; searched best first for many points together."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.points = centroids.astype(np.float32)
        self.norms = (self.points**2).sum(axis=1)
        n = len(self.points)
        self.links = np.full((n, degree + 2), -1, np.int32)
        for i, near in enumerate(self._nearest_all(min(n - 1, 3 * degree))):
            gaps = self._distances(self.points[near], near)
            gap = self._distances(self.points[[i]], near)[0]
            chosen: list[int] = []
            for j in range(len(near)):
                if len(chosen) < degree and (gaps[j, chosen] > gap[j]).all():
                    chosen.append(j)
            chosen += [j for j in range(len(near)) if j not in set(chosen)][: degree - len(chosen)]
            links = near[chosen].tolist()
            links += [j for j in {(i - 1) % n, (i + 1) % n} if j not in links]  # a ring, so that all can be reached
            self.links[i, : len(links)] = links

    def _distances(self, x: np.ndarray, to: np.ndarray | slice = slice(None)) -> np.ndarray:
        squares = (x**2).sum(axis=1)[:, None] - 2 * x @ self.points[to].T + self.norms[to]
        return np.maximum(squares, 0)

    def _nearest_all(self, k: int) -> Iterator[np.ndarray]:
        for i in range(0, len(self.points), 1024):
            d = self._distances(self.points[i : i + 1024])
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            yield from np.argsort(d, axis=1, kind="stable")[:, :k]

    def walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``x`` up to ``width`` near centroids, nearest first, their distances, and how many were looked at.

        -1 and infinity fill up. The links of the nearest that are still open are followed until none of those in view is.
        """
        n, m = len(self.points), len(x)
        width, rows = min(width, n), np.arange(m)[:, None]
        beam, dist = np.full((m, width), -1, np.int32), np.full((m, width), np.inf, np.float32)
        open_ = np.zeros((m, width), bool)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # stands for no centroid
        fresh = np.tile(np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int32)), (m, 1))
        squares = (x**2).sum(axis=1)[:, None]
        while True:
            fresh.sort(axis=1)
            known = seen[rows, fresh]
            known[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
            seen[rows, fresh] = True
            at = np.minimum(fresh, n - 1)
            d = np.maximum(squares - 2 * np.einsum("md,mfd->mf", x, self.points[at]) + self.norms[at], 0)
            d[known] = np.inf
            every = [np.concatenate(a, axis=1) for a in ((dist, d), (beam, fresh), (open_, ~known))]
            keep = np.argpartition(every[0], width - 1, axis=1)[:, :width]
            dist, beam, open_ = (np.take_along_axis(a, keep, axis=1) for a in every)
            open_ &= np.isfinite(dist)
            if not open_.any():
                break
            nearest = np.where(open_, dist, np.inf)
            best = np.argpartition(nearest, STEP - 1, axis=1)[:, :STEP] if width > STEP else np.tile(np.arange(width), (m, 1))
            has = np.take_along_axis(open_, best, axis=1)
            np.put_along_axis(open_, best, False, axis=1)
            links = self.links[np.take_along_axis(beam, best, axis=1) % n]
            fresh = np.where(has[:, :, None] & (links >= 0), links, n).reshape(m, -1)
        order = np.argsort(dist, axis=1, kind="stable")
        dist, beam = (np.take_along_axis(a, order, axis=1) for a in (dist, beam))
        return np.where(np.isfinite(dist), beam, -1), np.sqrt(dist), seen[:, :n].sum(axis=1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``walk``, without the counts."""
        near, dist, _ = self.walk(x, width)
        return near, dist

    def within(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """For each row of ``x`` the centroids up to ``ratio`` times as far as the nearest one, nearest first.

        A walk whose view they fill is done again with a wider one.
        """
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(x)
        left, width = np.arange(len(x)), BEAM
        while len(left):
            again = []
            for rows in np.split(left, range(256, len(left), 256)):
                near, dist = self.search(x[rows], width)
                inside = (near >= 0) & (dist <= dist[:, :1] * ratio)
                more = inside.all(axis=1) & (width < len(self.points))
                for i in np.flatnonzero(~more):
                    found[rows[i]] = near[i, inside[i]]
                again.append(rows[more])
            left, width = np.concatenate(again), 2 * width
        return found


def _halves(x: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two halves of ``x`` along the line between two means."""
    two = x[rnd.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = x @ (two[1] - two[0]) > ((two[1] ** 2).sum() - (two[0] ** 2).sum()) / 2
        if side.all() or not side.any():
            break
        two = np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)])
    order = np.argsort(x @ (two[1] - two[0]), kind="stable")
    return order[: len(x) // 2], order[len(x) // 2 :]


def _nearest_mean(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    half = (means**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ means.T - half, axis=1) for i in range(0, len(x), 4096)])


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 5) -> np.ndarray:
    """Centroids of ``lists`` parts of the sample of like size.

    The largest part is halved at the median between two means until there are enough. Then means and nearest parts take
    turns; a part of more than twice its share is halved again in each turn, and the smallest part makes room for it.
    """
    parts, rnd = [np.arange(len(sample))], np.random.default_rng(7)

    def halve(i: int) -> None:
        part = parts.pop(i)
        parts.extend(part[half] for half in _halves(sample[part], rnd))

    while len(parts) < lists:
        halve(max(range(len(parts)), key=lambda i: len(parts[i])))
    for _ in range(rounds):
        means = np.stack([sample[p].mean(axis=0) for p in parts])
        at = _nearest_mean(sample, means)
        order = np.argsort(at, kind="stable")
        parts = [p for p in np.split(order, np.searchsorted(at[order], np.arange(1, len(means)))) if len(p)]
        for _ in range(len(parts)):
            large = max(range(len(parts)), key=lambda i: len(parts[i]))
            if len(parts[large]) < 2 or len(parts) >= lists and len(parts[large]) <= 2 * len(sample) / lists:
                break
            if len(parts) >= lists:
                parts.pop(min(range(len(parts)), key=lambda i: len(parts[i])))
                large = max(range(len(parts)), key=lambda i: len(parts[i]))
            halve(large)
    return np.unique(np.stack([sample[p].mean(axis=0) for p in parts]), axis=0)


def near_lists(graph: CentroidGraph, stored: np.ndarray, replicas: int, border: float) -> list[np.ndarray]:
    """The lists that each stored vector goes to: the nearest, and up to ``replicas`` in all that are nearly as close."""
    near, dist = (a[:, :replicas] for a in graph.search(stored, max(BEAM, replicas)))
    keep = (near >= 0) & (dist <= dist[:, :1] * (1 + border))
    return [n[k] for n, k in zip(near, keep)]


def learnt_reach(
    graph: CentroidGraph, sample: np.ndarray, stored: np.ndarray, asking: np.ndarray, k: int, replicas: int, border: float, recall: float
) -> float:
    """By how much farther than the nearest list those lists are that hold ``recall`` of the ``k`` nearest of the first sampled vectors.

    ``stored`` and ``asking`` are the sample's vectors as they are listed and as they ask. The sample's nearest are farther than the
    table's, so the table's are found as surely at least.
    """
    k = min(k, len(sample) - 1)
    if k < 1:
        return 0.0
    asked = np.arange(min(ASKED, len(sample)))
    nearest = np.empty((len(asked), k), np.int64)
    for rows in np.split(asked, range(32, len(asked), 32)):  # few at a time: a row of scores is as long as the sample
        scores = sample[rows] @ sample.T
        scores[np.arange(len(rows)), rows] = -np.inf
        nearest[rows] = np.argpartition(scores, -k, axis=1)[:, -k:]
    used, place = np.unique(nearest, return_inverse=True)
    place = place.reshape(nearest.shape)
    lists = [part for i in range(0, len(used), 256) for part in near_lists(graph, stored[used[i : i + 256]], replicas, border)]
    ratios = []
    for i in asked:
        far = np.sqrt(graph._distances(asking[[i]])[0])
        ratios += [far[lists[j]].min() / max(far.min(), 1e-9) for j in place[i]]
    return max(float(np.quantile(ratios, recall, method="higher")) - 1, 0.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x`` (array<double>) of the vectors that can be searched: of the most common length, finite, not zero."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("x", lambda v: v != 0))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (common.d if common else 0))


def nearest(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    list_size: int = 256,
    replicas: int = 6,
    border: float = 0.1,
    recall: float = 0.95,
    reach: float | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` of the ``k`` nearest found for every vector with ``is_query``.

    The score is the inner product in double precision; ties go to the smaller id; a query is no neighbour of itself. NULL
    vectors, zero vectors, those with a NULL, NaN or infinite component, of another length than most, or under a NULL id take
    no part. Equal vectors are searched once and keep their ``k + 1`` least ids, the only ones that can be among the nearest.
    A repeated id counts once for each different vector it has. Fewer than ``k`` found send a query through all lists, so
    fewer come back only if there are fewer. Every vector is indexed; only the centroids and the ratio come from a sample (SAMPLE
    rows at most). A query reads the lists whose distance is up to ``1 + reach`` times the nearest one's; without a ``reach``, it is
    learnt so that ``recall`` of the sample's nearest are in them. Lists longer than BLOCK are cut into blocks, as are their
    queries, so no task holds more than one block of each.
    Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors, id_col, vector_col).withColumn("q", is_query(F.col("id")))
    rows = rows.distinct()
    # Spark keeps the least ids of a vector before they meet, so a vector that a third of the rows share stays small
    place = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    least = rows.select("id", "x", place.alias("place")).where(F.col("place") <= k + 1)
    distinct = least.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = cut_lineage(distinct.withColumn("n", F.monotonically_increasing_id()))
    asked = rows.where("q").select("id", "x").join(distinct.select("x", "n"), "x")
    asked = cut_lineage(asked.select("id", "x", "n"))
    count, norm, dim = distinct.agg(
        F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.max(F.size("x"))
    ).first()
    schema = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    if not count:
        return spark.createDataFrame([], schema)
    sample = distinct.select("x").orderBy(F.xxhash64("x")).limit(min(SAMPLE, CELLS // dim))
    sample = sample.select("x").toArrow().column("x").combine_chunks()

    def lifted(x: np.ndarray, stored: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(norm - (x**2).sum(axis=1), 0)) if stored else np.zeros(len(x))
        return np.concatenate([x, extra[:, None]], axis=1).astype(np.float32)

    sampled = _matrix(sample, dim)
    points = lifted(sampled, True)
    graph = CentroidGraph(balanced_centroids(points, min(LISTS, max(1, -(-count // list_size)), max(1, len(points) // 4))))
    if reach is None:
        reach = learnt_reach(graph, sampled, points, lifted(sampled[:ASKED], False), k, replicas, border, recall)
    sent = spark.sparkContext.broadcast(graph)

    def listed(stored: bool):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = sent.value
            for part in (whole.slice(i, 256) for whole in parts for i in range(0, whole.num_rows, 256)):
                x = lifted(_matrix(part.column("x"), dim), stored)
                lists = near_lists(graph, x, replicas, border) if stored else graph.within(x, 1 + reach)
                lists = [near.tolist() for near in lists]
                yield pa.RecordBatch.from_arrays([part.column("n"), pa.array(lists, pa.list_(pa.int32()))], names=["n", "lists"])

        return batches

    postings = distinct.select("n", "x").mapInArrow(listed(True), "n bigint, lists array<int>")
    postings = cut_lineage(postings.select("n", F.explode("lists").alias("list")))
    wanted = asked.groupBy("n").agg(F.first("x").alias("x"))
    reads = cut_lineage(wanted.mapInArrow(listed(False), "n bigint, lists array<int>").select("n", F.posexplode("lists").alias("place", "list")))
    slack = float(norm) * dim * 2.0**-50  # more than sums in another order can differ by
    found = _search(distinct, postings, reads, k + 1, slack)
    results = cut_lineage(_ranked(asked, found, distinct, k, id_col))
    total = F.lit(rows.count() - 1)
    # whoever found too few reads everything
    short = results.groupBy("query_id").count().where(F.col("count") >= F.least(F.lit(k), total))
    again = asked.join(short, asked.id == short.query_id, "left_anti")
    if again.isEmpty():
        return results
    parts = -(-2 * count // BLOCK)
    every = again.select("n").distinct().select("n", F.posexplode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("place", "list"))
    dealt = distinct.select("n", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int").alias("list"))
    more = _ranked(again, _search(distinct, dealt, every, k + 1, slack), distinct, k, id_col)
    return results.join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def _search(distinct: DataFrame, postings: DataFrame, reads: DataFrame, k: int, slack: float) -> DataFrame:
    """``query`` and ``n`` of the ``k`` best vectors in all lists a query reads, whose order is ``place``.

    A list gives up to ``k`` rows for a query that has found fewer than ``k`` before, then only those that may be among its ``k``
    best: nothing else is left out, and rows follow the queries and the number of rounds.
    """
    most = reads.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    found, start, end = None, 0, 1
    while start <= most:
        part = reads.where(F.col("place").between(start, end - 1)).select("n", "list")
        if found is None:
            part = part.withColumn("bound", F.lit(None).cast("double"))
        else:
            bound = F.when(F.count("*") >= k, F.min("score") - slack).alias("bound")
            part = part.join(found.groupBy(F.col("query").alias("n")).agg(bound), "n", "left")
        new = _scan(distinct, postings, part, k)
        near = (new if found is None else found.unionByName(new)).groupBy("query", "n")
        near = near.agg(F.max("score").alias("score"), F.first("least").alias("least"))
        first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
        found = cut_lineage(near.withColumn("first", first).where(F.col("first") <= k).drop("first"))
        start, end = end, end * ROUNDS
    return found.select("query", "n")


def _scan(distinct: DataFrame, postings: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``query``, ``n`` and ``score`` of the ``k`` best vectors of each block of each list a query reads, none below its ``bound``."""
    vectors = distinct.select("n", "x", F.col("ids")[0].alias("least"))
    kind = vectors.schema["least"].dataType.simpleString()
    sizes = _blocks(postings, "vb").join(_blocks(reads, "qb"), "list")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("n"), F.col(own)).cast("int").alias(own[0])
        held = rows.join(sizes, "list").select(*rows.columns, at, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))
        held = held.join(vectors, "n")
        return held.select(*[F.col(c).alias(c) for c in held.columns])  # new names for the co-grouping

    def best(key, stored: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(asking):
            return pd.DataFrame({"query": [], "n": [], "score": [], "least": []})
        n, least, x = stored["n"].to_numpy(), stored["least"].to_numpy(), np.stack(stored["x"].to_numpy())
        out = []
        for i in range(0, len(asking), 256):
            part = asking.iloc[i : i + 256]
            scores = np.stack(part["x"].to_numpy()) @ x.T
            row, at = _top(scores, least, k, part["bound"].to_numpy(float))
            out.append(pd.DataFrame({"query": part["n"].to_numpy()[row], "n": n[at], "score": scores[row, at], "least": least[at]}))
        return pd.concat(out, ignore_index=True)

    left = dealt(postings, "vb", "qb").groupBy("list", "v", "q")
    right = dealt(reads, "qb", "vb").groupBy("list", "v", "q")
    return left.cogroup(right).applyInPandas(best, f"query bigint, n bigint, score double, least {kind}")


def _top(scores: np.ndarray, least: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row that are not below its ``bound`` (NaN: none); ties go to the smaller id."""
    good = ~(scores < bound[:, None])
    many = np.flatnonzero(good.sum(axis=1) > k)
    if len(many):
        part = np.where(good[many], scores[many], -np.inf)
        good[many] &= part >= -np.partition(-part, k - 1, axis=1)[:, k - 1 : k]
    row, at = np.nonzero(good)
    order = np.lexsort((least[at], -scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def _ranked(asked: DataFrame, found: DataFrame, distinct: DataFrame, k: int, id_col: str) -> DataFrame:
    """The best ``k`` ids of every query, from the ids that the vectors found stand for.

    A query's own vector and k others hold all that can be among its k nearest, whatever the ties.
    """
    pairs = found.join(distinct.select("n", "ids", F.col("x").alias("y")), "n")
    pairs = pairs.join(asked.withColumnsRenamed({"id": "query_id", "n": "query"}), "query")
    # summed in the order of the components, so that equal pairs have equal scores
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    ids = pairs.select("query_id", "query", score.alias("score"), F.explode("ids").alias(id_col))
    ids = ids.where(F.col(id_col) != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), id_col))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
