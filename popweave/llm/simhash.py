"""Near-duplicate classes from SimHash fingerprints, searched by covering locality-sensitive hashing.

A fingerprint bit is 1 if more than half of a text's shingle hashes have it. Two texts link if their fingerprints differ in
at most ``radius`` bits. Every bit position gets a vector of ``radius + 1`` bits; for each of the ``2**(radius+1) - 1``
non-zero vectors there is a table whose mask keeps the positions orthogonal to it. Any ``radius`` differing positions leave
some non-zero vector orthogonal to all their complements' constraints, so every linked pair agrees under at least one mask.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from popweave.llm.components import connected_components
from popweave.llm.texts import map_texts
from popweave.session import cut_lineage

BITS = 64
SEED = 42
STEP = 1 << 16  # shingles whose bits are counted at a time
MEMBERS = 4096  # fingerprints of one bucket that a task compares with each other; larger buckets are split
PAIRS = 1 << 21  # pairs compared at a time


def covering_masks(radius: int) -> list[int]:
    """The masks, as signed 64-bit integers; positions take the non-zero vectors in turn.

    Where there are more vectors than positions, a fixed pseudo-random choice is taken, so that no mask keeps few bits.
    """
    vectors = (1 << (radius + 1)) - 1
    own = [i % vectors + 1 for i in range(BITS)]
    if vectors > BITS:
        own = random.Random(0).sample(range(1, vectors + 1), BITS)
    masks = []
    for v in range(1, vectors + 1):
        kept = sum(1 << i for i in range(BITS) if (own[i] & v).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    text = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = map(slice, (ends - sizes).tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, spans), repeat(SEED)), np.uint64, len(words) - k + 1)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _mixed(hashes: np.ndarray, j: int) -> np.ndarray:
    """Another hash of each hash, by the public splitmix64 finaliser."""
    x = hashes + np.uint64((j * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, distinct: bool = False) -> int:
    """Unsigned fingerprint; only A-Z is lower-cased, words are cut at ASCII white space, no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = _shingle_hashes(words, shingle)
    return _majority(np.unique(hashes) if distinct else hashes)


def sketch(text: str | None, shingle: int, lanes: int) -> bytes:
    """``lanes`` fingerprints of 64 bits over distinct shingles, big-endian, one after the other."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8 * lanes)
    hashes = np.unique(_shingle_hashes(words, shingle))
    return b"".join(_majority(_mixed(hashes, j + 1)).to_bytes(8, "big") for j in range(lanes))


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distinct: bool = False,
    sketch_shingle: int = 5,
    sketch_lanes: int = 0,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (long) and ``sketch`` (binary, empty without lanes) of every row, whole texts."""

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            value = fingerprint(text, shingle, distinct)
            yield value - (value >> 63 << 64), sketch(text, sketch_shingle, sketch_lanes)

    return map_texts(docs, {id_col: id_col}, text_col, "fingerprint bigint, sketch binary", work)


def _lanes(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1)


def _linked(x: np.ndarray, y: np.ndarray, radius: int, wide: np.ndarray, wide_y: np.ndarray, bits: int) -> np.ndarray:
    ok = np.bitwise_count(x ^ y) <= radius
    if wide.shape[-1]:
        ok &= np.bitwise_count(wide ^ wide_y).sum(axis=-1, dtype=np.int64) <= bits
    return ok


def _spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component once the links a-b are added."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels = labels[labels]
        if (labels == before).all():
            break
    while (labels[labels] != labels).any():
        labels = labels[labels]
    return labels


def _bucket_components(x: np.ndarray, wide: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int, bits: int) -> np.ndarray:
    """For each row the first row of its component inside its bucket; buckets are runs of rows."""
    labels = np.arange(len(x))
    for n in np.unique(size[size > 1]):
        at = start[size == n]
        i, j = np.triu_indices(n, 1) if n <= 64 else (None, None)
        if i is not None:  # many small buckets of one size together
            step = max(1, PAIRS // len(i))
            for k in range(0, len(at), step):
                a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                ok = _linked(x[a], x[b], radius, wide[a], wide[b], bits)
                labels = _spread(labels, a[ok], b[ok])
            continue
        step = max(1, PAIRS // n)
        for s in at:  # one large bucket, a band of rows against all
            for k in range(s, s + n, step):
                rows, cols = slice(k, min(k + step, s + n)), slice(s, s + n)
                near = np.argwhere(np.bitwise_count(x[rows, None] ^ x[None, cols]) <= radius)
                a, b = near[:, 0] + k, near[:, 1] + s
                if wide.shape[1]:
                    a, b = a[a < b], b[a < b]
                    ok = _linked(x[a], x[b], radius, wide[a], wide[b], bits)
                    a, b = a[ok], b[ok]
                labels = _spread(labels, a, b)
    return labels


def bucket_edges(rows: DataFrame, radius: int, sketch_bits: int = 0) -> DataFrame:
    """Distinct ``u``, ``v`` that join the members of each component inside a bucket of a table.

    ``rows`` holds ``node`` (long), ``fingerprint`` and ``sketch``, one row per node; without ``sketch_bits`` the node is the
    fingerprint. Only buckets of two or more move on.
    A bucket of more than MEMBERS is cut into blocks by a hash of the node and every pair of blocks is one unit of work, so
    no task ever holds more than two blocks, however many fingerprints share the kept bits, and no pair is missed. A unit
    gives at most one row per member instead of all its pairs.
    """
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    key = F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key")
    # what travels for every mask is as narrow as can be; sketches join those that share a bucket
    tables = rows.select("node", "fingerprint", F.posexplode(masks).alias("t", "mask")).select("node", "t", key)
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = tables.join(sizes, ["t", "key"])
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("node", "t"), blocks.cast("bigint")).cast("int")
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    held = held.select("node", "t", "key", F.explode(units).alias("unit"))
    held = held.select("node", F.xxhash64("t", "key", "unit.i", "unit.j").alias("unit"), "t", "key")
    if sketch_bits:
        held = held.join(rows.select("node", "fingerprint", "sketch"), "node")
    else:  # without sketches a node is its fingerprint
        held = held.select("*", F.col("node").alias("fingerprint"), F.unhex(F.lit("")).alias("sketch"))
    held = held.repartition("unit", "t", "key").sortWithinPartitions("unit", "t", "key", "fingerprint", "node")

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            keys = part[["unit", "t", "key"]].to_numpy()
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            yield edges_of(part.iloc[: new[-1]])
            rest = part.iloc[new[-1] :]
        if rest is not None:
            yield edges_of(rest)

    def edges_of(part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        keys = part[["unit", "t", "key"]].to_numpy()
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        size = np.diff(np.r_[start, len(part)])
        node = part["node"].to_numpy()
        label = _bucket_components(part["fingerprint"].to_numpy().view(np.uint64), _lanes(part["sketch"]), start, size, radius, sketch_bits)
        joined = label != np.arange(len(label))
        pairs = np.unique(np.stack([node[joined], node[label[joined]]], axis=1), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return held.mapInPandas(links, "u bigint, v bigint").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    distinct: bool = False,
    sketch_shingle: int = 5,
    sketch_lanes: int = 0,
    sketch_bits: int = 0,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (long) and ``component_id`` (least id that is reachable over links) of every row.

    Texts of fewer words than a shingle are one shingle; a NULL, empty or blank text has fingerprint 0 and links like any
    other, so all of them are one class. Rows with equal fingerprints are one node, so copies cost nothing past the
    fingerprint. Repeated rows come back as often as they came in. A NULL id keeps its row and never names a class unless
    the class has no other id. With ``sketch_lanes`` a link must also hold between sketches of ``64 * sketch_lanes`` bits
    over distinct shingles of ``sketch_shingle`` words, in at most ``sketch_bits`` bits. Other columns are not read. An
    empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle, distinct, sketch_shingle, sketch_lanes))
    # without a sketch the fingerprint names its node; with one, a hash of both does
    node = F.xxhash64("fingerprint", "sketch") if sketch_lanes else F.col("fingerprint")
    prints = prints.select(F.col(id_col).alias("id"), "fingerprint", "sketch", node.alias("node"))
    nodes = prints.groupBy("node", "fingerprint", "sketch").agg(F.min("id").alias("least"))
    nodes = cut_lineage(nodes)
    classes = connected_components(bucket_edges(nodes.drop("least"), radius, sketch_bits))
    named = nodes.join(classes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(heads, "component").select("node", "component_id")
    return prints.join(by_node, "node").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def hex_digits(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits of the unsigned value."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
