"""Connected components of an edge table, by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popweave.session import cut_lineage


def _with_least(edges: DataFrame) -> DataFrame:
    """Every edge with the least node among ``u`` and its neighbours; the sum is partial before it moves."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges`` (two columns of one orderable type).

    Alternates large-star and small-star steps until the edges stop changing, which takes a number of rounds that grows
    with the logarithm of the longest path. No neighbour list is ever gathered: a step is a minimum by node and a join,
    so a node with a third of all edges is split by the skew handling of the join. Each round is cut by a reliable
    checkpoint. Loops and NULLs are ignored; no edges give no rows.
    """
    u, v = edges.columns
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = cut_lineage(edges)
    state = None
    while True:
        # large star: neighbours above a node move to the least node around it
        around = _with_least(_both_ways(edges)).where(F.col("v") > F.col("u"))
        edges = around.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: a node and its lower neighbours move to the least of them
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        moved = _with_least(down)
        edges = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(moved.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = cut_lineage(edges)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    members = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    heads = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return members.unionByName(heads)
