"""Near-duplicate classes by the exact Jaccard similarity of texts' sets of word shingles.

Two searches find candidates. SimHash fingerprints of the sets link within RADIUS bits, by the covering masks of ``simhash``.
At a similarity of 0.8 fingerprints differ in some ten bits, which no bounded number of masks covers, so min-hash bands add the
pairs that are farther apart: two texts meet if all ROWS minima of one of BANDS bands agree, which a pair at 0.8 misses once in
190,000, and are loosely linked if their signatures agree almost often enough. The classes of the loose links of both searches
hold every pair that can matter, so the sets of their texts alone travel, and every pair in them that decides anything is
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from popweave.llm.components import connected_components
from popweave.llm.simhash import _majority, _mixed, _shingle_hashes, bucket_edges
from popweave.llm.texts import map_texts
from popweave.operators.joins import likely_members
from popweave.session import cut_lineage

RADIUS = 3
BANDS, ROWS = 40, 6
LOOSE = 161  # of BANDS * ROWS minima that agree: five standard deviations below their mean at 0.8
STEP = 1 << 12  # shingles whose minima are taken at a time
MEMBERS = 4096  # signatures of one bucket that a task holds; larger buckets are cut into blocks
SETS = 512  # shingle sets of one loose class that a task holds; larger classes are cut into blocks
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; only A-Z is lower-cased; fewer words than a shingle are one shingle."""
    return np.unique(_shingle_hashes((text or "").encode().lower().split(), shingle))


def _minima(hashes: np.ndarray) -> np.ndarray:
    parts = [(hashes[i : i + STEP, None] * _FACTORS).min(axis=0) for i in range(0, len(hashes), STEP)]
    return np.min(parts, axis=0)


def _signed(value: int) -> int:
    return value - (value >> 63 << 64)


def _classes(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """First member of each one's class; whoever is reached is compared no more with those reached before."""
    labels, rest = np.arange(n), np.arange(n)
    while len(rest):
        head, rest = rest[0], rest[1:]
        queue = [head]
        while queue and len(rest):
            hit = linked(queue.pop(), rest)
            labels[rest[hit]] = head
            queue.extend(rest[hit])
            rest = rest[~hit]
    return labels


def _alike(signatures: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda i, rest: (signatures[rest] == signatures[i]).sum(axis=1) >= LOOSE


def _similar(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether the Jaccard similarity is 0.8 or more, in whole numbers."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values, at = np.unique(np.concatenate(sets), return_inverse=True)

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(values), bool)
        mark[at[starts[i] : starts[i] + sizes[i]]] = True
        common = np.add.reduceat(mark[at], starts, dtype=np.int64)[rest]
        return 5 * common >= 4 * (sizes[i] + sizes[rest] - common)

    return linked


def _links(rows: DataFrame, group: list[str], limit: int, values: DataFrame, near: Callable) -> DataFrame:
    """Distinct ``u``, ``v`` that join the classes of ``near`` inside the groups of ``rows`` (``node`` and ``group``).

    A group of more than ``limit`` is cut into blocks by a hash of the node and every pair of blocks is one unit of work, so
    no pair is missed. ``values`` holds ``node`` and ``value`` (binary), which joins the members of groups of two or more. A
    unit gives at most one row per member.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64("node", *group), blocks.cast("bigint")).cast("int")
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    held = rows.join(sizes, group).select("node", *group, F.explode(units).alias("unit"))
    held = held.select("node", F.xxhash64(*group, "unit.i", "unit.j").alias("unit")).join(values, "node")
    held = held.repartition("unit").sortWithinPartitions("unit", "node")

    def edges_of(part: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        if len(part):
            node, unit, value = part["node"].to_numpy(), part["unit"].to_numpy(), part["value"].to_numpy()
            for run in np.split(np.arange(len(part)), np.flatnonzero(unit[1:] != unit[:-1]) + 1):
                if len(run) > 1:
                    label = _classes(len(run), near(value[run]))
                    joined = np.flatnonzero(label != np.arange(len(run)))
                    u.append(node[run[joined]]), v.append(node[run[label[joined]]])
        none = [np.array([], np.int64)]
        return pd.DataFrame({"u": np.concatenate(u + none), "v": np.concatenate(v + none)})

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = np.searchsorted(part["unit"].to_numpy(), part["unit"].iloc[-1]) if len(part) else 0
            yield edges_of(part.iloc[:last])
            rest = part.iloc[last:]
        if rest is not None:
            yield edges_of(rest)

    return held.mapInPandas(work, "u bigint, v bigint").distinct()


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """``u``, ``v`` that join the nodes whose fingerprints reach each other in steps of at most ``radius`` bits.

    ``nodes`` holds ``node`` and ``fingerprint``. Nodes of one fingerprint are linked to the least of them, which stands for all.
    """
    heads = nodes.groupBy("fingerprint").agg(F.min("node").alias("head"))
    same = nodes.join(heads, "fingerprint").where(F.col("node") != F.col("head")).select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = bucket_edges(heads.select(F.col("fingerprint").alias("node"), "fingerprint"), radius)
    for end in ("u", "v"):
        near = near.join(heads.select(F.col("fingerprint").alias(end), F.col("head").alias(f"{end}_head")), end)
    return same.unionByName(near.select(F.col("u_head").alias("u"), F.col("v_head").alias("v")))


def shingle_groups(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``id_col`` and ``component_id`` (least id that is reachable over links) of every row.

    Two texts link if the Jaccard similarity of their sets of shingles is 0.8 or more. Texts of equal sets are one node. Ids
    are not NULL and differ from row to row. A NULL, empty or blank text has the set of the empty shingle, so all of them are
    one class. An empty table gives no rows.
    """

    def signed(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            hashes = shingle_set(text, shingle)
            value = _mixed(_minima(hashes), 1).astype(np.uint8).tobytes()
            yield _signed(xxhash.xxh64_intdigest(hashes.tobytes())), _signed(_majority(hashes)), value

    def sets(texts: Iterator[str]) -> Iterator[tuple]:
        return ((shingle_set(text, shingle).tobytes(),) for text in texts)

    fields = "node bigint, fingerprint bigint, value binary"
    prints = cut_lineage(map_texts(docs, {"id": id_col}, text_col, fields, signed))
    firsts = [F.first(c).alias(c) for c in ("fingerprint", "value")]
    nodes = cut_lineage(prints.groupBy("node").agg(F.min("id").alias("least"), *firsts))
    # a band is cut from the signature, whose bytes agree wherever minima do
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda t: F.xxhash64(F.substring("value", t * ROWS + 1, F.lit(ROWS)), t))
    buckets = nodes.select("node", F.explode(bands).alias("key"))
    alike = lambda value: _alike(np.frombuffer(b"".join(value), np.uint8).reshape(len(value), -1))
    banded = _links(buckets, ["key"], MEMBERS, nodes.select("node", "value"), alike)
    loose = cut_lineage(connected_components(fingerprint_links(nodes.select("node", "fingerprint"), RADIUS).unionByName(banded)))
    heads = cut_lineage(loose.join(nodes.select("node", "least"), "node").select("node", "least"))
    texts = docs.select(F.col(id_col).alias("least"), F.col(text_col).alias("text"))
    texts = likely_members(texts, "least", heads).join(heads, "least")  # texts without a loose link do not move
    similar = lambda value: _similar([np.frombuffer(v, np.uint64) for v in value])
    exact = _links(loose, ["component"], SETS, map_texts(texts, {"node": "node"}, "text", "value binary", sets), similar)
    classes = connected_components(exact)
    named = nodes.join(classes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(first, "component").select("node", "component_id")
    return prints.select("id", "node").join(by_node, "node").select(F.col("id").alias(id_col), "component_id")
