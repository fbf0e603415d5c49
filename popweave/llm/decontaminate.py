"""Benchmark passages inside documents, by a prefix-filtered join of word shingles.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window). A window occurs in a text only if
all its shingles do, so one of them, its prefix, is enough to find it: the one that is rarest in the corpus. Only text
positions whose shingle may be a prefix leave the scan, each with the words around it. The join on the prefix aligns the two
sides; how far the words agree to the left and right bounds which windows fit there, and decides them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popweave.llm.texts import map_texts, remembers
from popweave.session import cut_lineage

SHINGLE = 5
FILTER_BITS = 27  # the broadcast filter is a bit map of this fixed size (16 MB), whatever the benchmark's size
MEMO = 500_000  # words whose hash a worker remembers
BASE = np.uint64(0x9E3779B97F4A7C15)

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_LOWER = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHash()
remembers(__name__, _HASHES)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_hashes(words: list[bytes], sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the hash of the shingle at each position, as signed integers."""
    single = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out = {}
    for k in sizes:
        n = len(words) - k + 1
        if n > 0:
            h = single[:n].copy()
            for j in range(1, k):
                h = h * BASE + single[j : j + n]
            out[k] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)).view(np.int64)
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)


class BitFilter:
    """A bit map that has the slots of all hashes of a table: no hash is missed, a few others pass."""

    def __init__(self, spark: SparkSession, hashes: DataFrame):
        slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
        bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - FILTER_BITS}) % 64 AS INT))")
        held = hashes.groupBy(F.floor(slot / 64).cast("int").alias("i")).agg(F.bit_or(bit).alias("w"))
        table = held.toArrow()  # at most 2**(FILTER_BITS - 6) rows
        self._sent = spark.sparkContext.broadcast((table.column("i").to_numpy(), table.column("w").to_numpy()))
        self._bits = None

    def __getstate__(self):
        return {"_sent": self._sent, "_bits": None}

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if self._bits is None:
            self._bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
            index, words = self._sent.value
            self._bits[index] = words.view(np.uint64)
        slot = _slot(hashes)
        return (self._bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per item with words: ``item`` (row number), ``id``, ``words``, window length ``len``, shingle size ``k``, hashes ``hs``."""

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            words = words_of(text)
            k = min(SHINGLE, window, len(words))
            hashes = shingle_hashes(words, [k])[k].tolist() if words else []
            yield [w.decode() for w in words], min(window, len(words)), k, hashes

    fields = "words array<string>, len int, k int, hs array<bigint>"
    own = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("item"))
    rows = map_texts(own, {"item": "item", "id": "id"}, "t", fields, work)
    return cut_lineage(rows.where("len > 0"))


def _corpus_counts(docs: DataFrame, text_col: str, sizes: list[int], known: BitFilter) -> DataFrame:
    """``h`` and ``n``: how often each shingle that may be an item's occurs in the corpus."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [np.array([], np.int64)]
            for text in part.column(0):
                for h in shingle_hashes(words_of(text.as_py()), sizes).values():
                    found.append(h[known.passes(h)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    partial = docs.select(text_col).mapInArrow(batches, "h bigint, n bigint")
    return partial.groupBy("h").agg(F.sum("n").alias("n"))


def _prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per item position that is the prefix of some windows: those that start from ``first`` to ``last``.

    Rarest shingle first; among equals those on a grid of window stride, so that neighbouring windows share one.
    """
    at = items.select("item", "len", "k", F.posexplode("hs").alias("q", "h")).join(counts, "h", "left")
    span = F.col("len") - F.col("k") + 1
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), ((F.col("q") + 1) % span != 0).alias("off"), F.col("q").alias("q"))
    ranked = at.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("q", order.alias("o")))).alias("ranked"))
    chosen = items.join(ranked, "item").select(
        "*",
        F.expr(
            "transform(sequence(0, size(words) - len), s -> struct(s AS s,"
            " array_min(transform(slice(ranked, s + 1, len - k + 1), r -> r.o)).q AS q))"
        ).alias("windows"),
    )
    runs = chosen.select("item", F.explode("windows").alias("x")).groupBy("item", F.col("x.q").alias("q"))
    runs = runs.agg(F.min("x.s").alias("first"), F.max("x.s").alias("last"))
    return items.join(runs, "item").select(
        "id",
        "q",
        "first",
        "last",
        "len",
        F.expr("hs[q]").alias("h"),
        F.expr("reverse(slice(words, greatest(q - (len - k), 0) + 1, least(q, len - k)))").alias("left"),
        F.expr("slice(words, q + 1, len)").alias("right"),
    )


def _agreement(a: str, b: str) -> Column:
    """Number of leading elements that two arrays share."""
    same = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return F.expr(f"CASE WHEN array_position({same}, false) = 0 THEN size({same}) ELSE array_position({same}, false) - 1 END")


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``spans`` and ``items``.

    ``spans`` are the word ranges (``lo``, ``hi`` exclusive, sorted, may overlap) inside occurrences of item windows, ``items``
    the sorted distinct item ids, as strings, that have one. NULL, empty or wordless texts have no words, no spans and no
    items; such items have no windows. Items under a NULL id mark words but are not named; items that repeat an id are one.
    Repeated document rows, also under one id or NULL, are judged each for itself. An empty benchmark marks nothing, empty
    documents give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_id_col, item_text_col, window)
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most SHINGLE values
    known = BitFilter(spark, items.select(F.explode("hs").alias("h")))
    prefixes = cut_lineage(_prefixes(items, _corpus_counts(docs, text_col, sizes, known)))
    wanted = BitFilter(spark, prefixes.select("h"))
    reach = window  # words kept on either side of a position

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            words, hits = words_of(text), []
            for h in shingle_hashes(words, sizes).values():
                for p in np.flatnonzero(wanted.passes(h)).tolist():
                    left = [w.decode() for w in words[max(0, p - reach) : p][::-1]]
                    right = [w.decode() for w in words[p : p + reach]]
                    hits.append({"p": p, "h": int(h[p]), "l": left, "r": right})
            yield len(words), hits

    fields = "n_words bigint, hits array<struct<p:bigint,h:bigint,l:array<string>,r:array<string>>>"
    scanned = map_texts(docs, {"doc": id_col}, text_col, fields, work)
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))
    found = scanned.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    met = found.join(prefixes, "h").withColumns({"before": _agreement("l", "left"), "after": _agreement("r", "right")})
    low = F.greatest("first", F.col("q") - F.col("before"))
    high = F.least("last", F.col("q") + F.col("after") - F.col("len"))
    met = met.withColumns({"low": low, "high": high}).where("low <= high")
    per_row = met.groupBy("row").agg(
        F.array_sort(F.collect_set(F.expr("struct(p - q + low AS lo, p - q + high + len AS hi)"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("items"),
    )
    spans = "array<struct<lo:bigint,hi:bigint>>"
    return scanned.join(per_row, "row", "left").select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("spans", F.array().cast(spans)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(spans: str = "spans") -> Column:
    """Number of words in the union of sorted spans."""
    return F.expr(
        f"aggregate({spans}, struct(0L AS reach, 0L AS n), (a, s) -> struct(greatest(a.reach, s.hi) AS reach,"
        " a.n + greatest(0L, s.hi - greatest(s.lo, a.reach)) AS n), a -> a.n)"
    )
