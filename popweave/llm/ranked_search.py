"""Ranked lexical search the other way round: documents stream through an inverted index of the items.

Items are few against the documents, so they are indexed, in blocks of bounded size, and the index is broadcast. Every document
brings the counts of its terms once; a term leads to the items that hold it, and each item keeps a heap of its best documents.
A task gives back one heap per item, and the heaps are merged by Spark. The corpus statistics that weigh the terms come from
all documents.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from popweave.llm.texts import map_texts
from popweave.session import cut_lineage, ship_package

POSTINGS = 1_000_000  # terms of all items in a block together; only a single longer item may pass this
ITEMS = 4_096  # items in a block
DOCS = 128  # documents whose scores are held at once
PAIRS = 1 << 21  # term and item pairs that are added up at once, unless one document has more

_LETTERS = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
# letters and digits stay, A-Z in lower case; every other ASCII character is a gap; longer UTF-8 signs have bytes from 128 on
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and b in _LETTERS else b if b in _LETTERS else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms in their order: runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Last:
    """An id in a heap, where the larger one is the worse and NULL the worst."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other: _Last) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id


class ItemIndex:
    """From a term's number to the items that hold it; weights come with the terms."""

    def __init__(self, term: np.ndarray, item: np.ndarray, weights: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.items = item[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.weights = weights
        self.n_items = int(item.max()) + 1 if len(item) else 0

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, docs: int) -> np.ndarray:
        """Scores (documents by items) of the counts ``tf`` of ``term`` in ``doc``, all in 64-bit integers."""
        out = np.zeros(docs * self.n_items, np.int64)
        worth = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        first, n = self.starts[term], self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(n)
        at = 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            reps = n[at:to]
            inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            place = np.repeat(doc[at:to] * self.n_items, reps) + self.items[np.repeat(first[at:to], reps) + inner]
            np.add.at(out, place, np.repeat(worth[at:to], reps))
            at = to
        return out.reshape(docs, self.n_items)


class Heaps:
    """The ``k`` best documents of every item: highest score first, then smallest id, NULL ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.floor = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def update(self, scores: np.ndarray, ids: list) -> None:
        # a score at the floor can still win by its id
        for d, i in zip(*(a.tolist() for a in np.nonzero((scores >= self.floor) & (scores > 0))), strict=True):
            heap, entry = self.heaps[i], (int(scores[d, i]), _Last(ids[d]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """``items`` with a ``block`` each, and the number of blocks; block sizes are checked, not only expected."""
    n, held = items.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-held // POSTINGS))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("held"))
        if sizes.where((F.col("n") > 1) & ((F.col("n") > ITEMS) | (F.col("held") > POSTINGS))).isEmpty():
            return dealt, blocks
        blocks *= 2


def _best(counts: DataFrame, index: ItemIndex, numbers: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """``no`` (of the item), ``id`` and ``score``: every task's heaps over its documents' term counts."""
    sent = counts.sparkSession.sparkContext.broadcast((index, numbers))
    kind = to_arrow_type(counts.schema["id"].dataType)

    def heaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, nos = sent.value
        best = Heaps(found.n_items, k)
        for part in (whole.slice(i, DOCS) for whole in parts for i in range(0, whole.num_rows, DOCS)):
            n = part.column("n").to_numpy()
            lists = part.column("terms")
            doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            term, tf = (part.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            m = 100 - 90 + (90 * n * total) // length
            best.update(found.scores(doc, term, tf, m, len(n)), part.column("id").to_pylist())
        rows = [(int(nos[i]), e[1].id, e[0]) for i, heap in enumerate(best.heaps) for e in heap]
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), kind, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["no", "id", "score"])

    schema = f"no bigint, id {counts.schema['id'].dataType.simpleString()}, score bigint"
    return counts.select("id", "n", "terms", "tfs").mapInArrow(heaps, schema)


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_col``, ``rank`` (from 1), ``id_col`` and ``score`` of every item's ``k`` best documents with a score above 0.

    A score sums, over the item's distinct terms, the term's weight floor(1000 ln((2N+2)/(2df+1))) times
    10^9 tf div (1000 tf + 8 m) with m = 10 + 90 n N div L. Equal scores go by ascending id. NULL and empty texts hold no terms:
    as documents they don't count, as items they give no rows. Every row of either table stands for itself: repeated documents take
    a rank each, a repeated item is answered as often as it occurs. NULL ids stay and come after others of equal score. Other
    columns are not read. Empty tables give no rows.

    Items are indexed in blocks of ITEMS items and POSTINGS terms, and each block's terms are counted once in every document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    numbered = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t"), F.monotonically_increasing_id().alias("no"))
    asked = map_texts(numbered, {"item": "item", "no": "no"}, "t", "terms array<binary>", lambda texts: ((sorted(set(terms_of(t))),) for t in texts))
    asked = cut_lineage(asked.where(F.size("terms") > 0))
    asked, blocks = _blocks(asked)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    answers = spark.createDataFrame([], f"no bigint, id {kinds[0]}, score bigint")
    for block in range(blocks):
        block_of = asked.where(F.col("block") == block).select("no", "terms").orderBy("no").toArrow()
        numbers = block_of.column("no").to_numpy()
        if not len(numbers):
            continue
        held = [terms.as_py() for terms in block_of.column("terms")]
        names = sorted({t for terms in held for t in terms})
        known = {t: i for i, t in enumerate(names)}
        counts = cut_lineage(_term_counts(docs, known, id_col, text_col))
        total, length = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not length:
            break
        # partial sums meet in at most one row a task for each term of the block
        df = np.zeros(len(names), np.int64)
        spread = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[spread.column("term").to_numpy()] = spread.column("count").to_numpy()
        weights = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
        term = np.array([known[t] for terms in held for t in terms], np.int64)
        item = np.repeat(np.arange(len(held)), [len(terms) for terms in held])
        answers = answers.unionByName(_best(counts, ItemIndex(term, item, weights), numbers, total, length, k))
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    merged = answers.withColumn("rank", place).where(F.col("rank") <= k)
    return merged.join(asked.select("no", "item"), "no").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )


def _term_counts(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` (all terms), and ``terms`` and ``tfs``: numbers and counts of the terms in ``known``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        number = sent.value
        for text in texts:
            terms = terms_of(text)
            mine = {number[t]: c for t, c in Counter(terms).items() if t in number}
            yield len(terms), list(mine), list(mine.values())

    return map_texts(docs, {"id": id_col}, text_col, "n bigint, terms array<int>, tfs array<bigint>", work)
