"""Document quality by ordinal cumulative-link regression on graded ratings over hashed text.

All grades share one weight per hashed feature; ordered thresholds cut the score into grades:
P(grade > j) = logistic(weights . features - threshold j). Features are the words and the shapes of a whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from popweave.llm.texts import map_texts, remembers

BITS = 18  # 2**BITS weights
SAMPLE_ROWS = 6_000  # rated rows that the fit reads, at most
SAMPLE_CELLS = 2_500_000  # features of those rows together, at most: further rows are left out, whole
MEMO = 50_000  # words whose features a worker remembers

_RUNS = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\dX_]+"), "x"), (re.compile("[0-9]+"), "9")]


def shape_of(word: str) -> str:
    """The word with runs of capitals, other letters and digits as X, x and 9, whole."""
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word


class _Slots(dict):
    """The slots of a word and of its shape, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        own = xxhash.xxh32_intdigest(word.lower()) >> (32 - BITS)
        shape = xxhash.xxh32_intdigest(shape_of(word), 1) >> (32 - BITS)
        value = self[word] = own << 32 | shape
        return value


_SLOTS = _Slots()
remembers(__name__, _SLOTS)
_PAIRS = np.array([xxhash.xxh32_intdigest(name, 2) >> (32 - BITS) for name in ("same", "other")], np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights: log counts of words, of shapes, and of words that do and don't repeat the word before.

    Each of the three kinds is scaled to length 1. No words, no features.
    """
    words = text.split()
    counts = Counter(words)
    if not counts:
        return np.array([], np.int64), np.array([], np.float32)
    both = np.fromiter(map(_SLOTS.__getitem__, counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    same = sum(map(eq, words, islice(words, 1, None)))
    pairs = np.log1p([same, len(words) - same])
    slots, values = [_PAIRS], [pairs / np.sqrt((pairs**2).sum())]
    for kind in (both >> 32, both & 0xFFFFFFFF):
        slot, at = np.unique(kind, return_inverse=True)
        value = np.log1p(np.bincount(at, weights=n))
        slots.append(slot), values.append(value / np.sqrt((value**2).sum()))
    return np.concatenate(slots), np.concatenate(values).astype(np.float32)


@dataclass
class Ordinal:
    """``weights`` of the slots and ``thresholds`` in order, one fewer than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade > j) for each j, falling."""
        slots, values = features(text)
        z = float(self.weights[slots] @ values) if len(slots) else 0.0
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -30, 30)))


def fit(
    slots: list[np.ndarray],
    values: list[np.ndarray],
    grades: np.ndarray,
    n_grades: int,
    rounds: int = 300,
    ridge: float = 1e-4,
) -> Ordinal:
    """Largest likelihood with a ridge, by gradient steps over all rows; ``grades`` run from 0 to ``n_grades - 1``.

    Thresholds are a first one and logarithms of positive gaps, so they stay in order. No rows give weights of 0.
    """
    weights, n = np.zeros(1 << BITS), len(grades)
    theta = np.concatenate([[-(n_grades - 2) / 2.0], np.zeros(max(n_grades - 2, 0))])
    if not n:
        return Ordinal(weights, np.cumsum(np.r_[theta[:1], np.exp(theta[1:])]))
    slot, value = np.concatenate(slots), np.concatenate(values).astype(np.float32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in slots])
    used = np.flatnonzero(np.bincount(slot, minlength=1 << BITS))
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(len(used))
    place = number[slot]
    w = np.zeros(len(used))
    first, second = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.r_[theta[:1], np.exp(theta[1:])])
        z = np.bincount(row, weights=w[place] * value, minlength=n)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))  # P(grade > j)
        upper = np.c_[np.ones(n), above][np.arange(n), grades]
        lower = np.c_[above, np.zeros(n)][np.arange(n), grades]
        chance = np.maximum(upper - lower, 1e-9)
        # how the likelihood of each row's grade changes with z minus each threshold
        slope = above * (1 - above)
        pull = np.zeros_like(above)
        has_upper, has_lower = grades > 0, grades < n_grades - 1
        at = np.arange(n)
        pull[at[has_upper], grades[has_upper] - 1] += (slope[at[has_upper], grades[has_upper] - 1]) / chance[has_upper]
        pull[at[has_lower], grades[has_lower]] -= (slope[at[has_lower], grades[has_lower]]) / chance[has_lower]
        by_z = pull.sum(axis=1)
        g_w = np.bincount(place, weights=by_z[row] * value, minlength=len(w)) / n - ridge * w
        by_cut = -pull.sum(axis=0) / n
        tail = np.cumsum(by_cut[::-1])[::-1]  # every gap moves all later thresholds
        grad = np.r_[g_w, tail[:1], tail[1:] * np.exp(theta[1:])]
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w += step[: len(w)]
        theta += step[len(w) :]
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.r_[theta[:1], np.exp(theta[1:])]))


def train(
    docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text"
) -> Ordinal:
    """Fit on the texts of rated rows. ``grade`` is an expression over ``ratings``; rows where it is NULL or out of range are not rated.

    The fit reads at most SAMPLE_ROWS rows, by a hash of the id, and SAMPLE_CELLS features. An id that is rated or written
    more than once counts as often. A NULL text has no features.
    """
    rated = ratings.select(F.col(id_col).alias("k"), grade.cast("int").alias("g")).where(F.col("g").between(0, n_grades - 1) & F.col("k").isNotNull())
    order = F.xxhash64("k")
    chosen = rated.orderBy(order, "k", "g").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            slots, values = features(text)
            yield slots.astype(np.int32), values

    made = map_texts(rows, {"k": "k", "g": "g"}, "t", "slots array<int>, vals array<float>", work)
    made = made.orderBy(F.xxhash64("k"), "k", "g", F.xxhash64("slots")).limit(SAMPLE_ROWS)
    so_far = F.sum(F.size("slots")).over(Window.orderBy(F.xxhash64("k"), "k", "g", F.xxhash64("slots")).rowsBetween(Window.unboundedPreceding, 0))
    table = made.withColumn("cells", so_far).where(F.col("cells") <= SAMPLE_CELLS).select("g", "slots", "vals").toArrow()
    slots = [s.values.to_numpy() for s in table.column("slots")]
    values = [v.values.to_numpy() for v in table.column("vals")]
    return fit(slots, values, table.column("g").to_numpy().astype(np.int64), n_grades)


def rate(
    docs: DataFrame,
    model: Ordinal,
    at_least: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, str] | None = None,
) -> DataFrame:
    """``id_col``, ``expected_grade`` and ``tail``, the probability of grade ``at_least`` or better, of every row's whole text.

    NULL, empty and blank texts have no features and get what the thresholds alone say. Equal texts are rated alike; repeated
    rows and NULL ids stay as they are; of other columns only those of ``keep`` (new name: old name) come back. An empty table
    gives no rows. The model (2 MB, of fixed size) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            tails = sent.value.tails(text)
            yield float(tails.sum()), float(tails[at_least - 1])

    return map_texts(docs, keep or {id_col: id_col}, text_col, "expected_grade double, tail double", work)
