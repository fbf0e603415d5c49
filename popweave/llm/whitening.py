"""Whitening of embeddings on their leading principal components.

Sums and centred products are added up by Spark; only one matrix of the vectors' width reaches the driver. Its eigenvectors come
from spectral divide and conquer: the polar factor of the covariance less a shift, found by the dynamically weighted Halley
iteration, gives the projector on the eigenvalues above the shift; both invariant subspaces are split further until nothing is
left to split. The components are then broadcast and every vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from popweave.session import ship_package

EPS = np.finfo(float).eps
BLOCK = 4_096  # vectors that a task multiplies at once
LARGEST = 2.0**43  # entries from here on have no whole number of 1/1024 in a long


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of the symmetric matrix ``a``, which for a spectrum without 0 is its matrix sign."""
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(len(a))
    x, low, one = a / norm, EPS, np.eye(len(a))
    for _ in range(30):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        p = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            upper, lower = np.split(np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0], 2)
            new = q / r * x + (p - q / r) / np.sqrt(r) * upper @ lower.T
        else:
            new = q / r * x + (p - q / r) * np.linalg.solve(one + r * x @ x, x)
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        moved, x = np.linalg.norm(new - x), new
        if moved < EPS ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvalues above a shift, and how many; None if nothing splits."""
    k, scale = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.trace(a) / k * np.eye(k)) / np.sqrt(k)
    rnd = np.random.default_rng(5)
    best = None
    # the mean lies between the least and the largest eigenvalue, whatever the matrix
    for shift in [float(np.median(diagonal)), np.trace(a) / k, *(np.trace(a) / k + spread * f for f in (0.3, -0.3, 0.1, -0.1, 0.7, -0.7))]:
        projector = (polar_factor(a - shift * np.eye(k)) + np.eye(k)) / 2
        r = int(round(np.trace(projector)))
        if not 0 < r < k:
            continue
        basis = np.linalg.qr(projector @ rnd.standard_normal((k, r)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        left = np.linalg.norm(basis[:, :r].T @ a @ basis[:, r:])
        if best is None or left < best[0]:
            best = left, basis, r
        if left <= 10 * k * EPS * scale:
            break
    return None if best is None else best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric matrix ``a``, falling, and eigenvectors as columns; the largest entry of each is positive."""
    scale = max(np.linalg.norm(a), np.finfo(float).tiny)

    def solve(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(part)
        if k == 1 or np.linalg.norm(part - np.diag(np.diag(part))) <= EPS * scale:
            return np.diag(part).copy(), np.eye(k)
        found = _split(part)
        if found is None:  # a multiple of the identity but for rounding
            return np.diag(part).copy(), np.eye(k)
        basis, r = found
        values, vectors = [], []
        for half in (basis[:, :r], basis[:, r:]):
            inner = half.T @ part @ half
            e, v = solve((inner + inner.T) / 2)
            values.append(e)
            vectors.append(half @ v)
        return np.concatenate(values), np.concatenate(vectors, axis=1)

    values, vectors = solve((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x`` (array<double>) of the vectors without NULL, NaN or infinite entries; empty ones have none and go."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(F.size("x") > 0)
    return rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _whole(part: pa.RecordBatch, dim: int) -> np.ndarray:
    c = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(1024 * c).astype(np.int64) + 100_000


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, BLOCK) for whole in parts for i in range(0, whole.num_rows, BLOCK))


def _sums(rows: DataFrame, made: Callable[[pa.RecordBatch], np.ndarray], width: int, kind: str) -> np.ndarray:
    """Sum over all rows of each of the ``width`` columns that ``made`` gives; a task sends one number a column."""

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64 if kind == "bigint" else float)
        for part in _pieces(parts):
            total += made(part).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    table = rows.mapInArrow(partial, f"i int, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(width, np.int64 if kind == "bigint" else float)
    out[table.column("i").to_numpy()] = table.column("s").to_numpy()
    return out


def _covariance(rows: DataFrame, made: Callable[[pa.RecordBatch], np.ndarray], width: int, n: int) -> np.ndarray:
    """Sum over all rows of the products of the centred columns that ``made`` gives, over ``n``.

    A task sends one matrix, row by row; the rows of a number are added up together, in the order of their tasks.
    """

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in _pieces(parts):
            centred = made(part)
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("task")["row"].to_numpy()
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(ordered), axis=0)]})

    sent = rows.mapInArrow(partial, "i int, row array<double>").withColumn("task", F.spark_partition_id())
    table = sent.groupBy("i").applyInPandas(added, "i int, row array<double>").toArrow()
    out = np.zeros((width, width))
    for i, row in zip(table.column("i").to_pylist(), table.column("row")):
        out[i] = row.values.to_numpy()
    return (out + out.T) / 2 / n


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: ``id_col``, ``component`` (from 1, by falling variance), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    Vectors count in whole numbers x = floor(1024 c) + 100000. ``n`` vectors are fitted on, all that are usable. ``deviation`` is
    the exact sum over dimensions of (n x - S)^2 with the sums S; NULL where that passes a long. ``whitened`` is x - S/n projected
    on the component over the root of its variance, ``explained`` that variance's share. ``identity_error`` is the largest absolute entry
    of the covariance of ``whitened`` less the identity.

    NULL vectors, empty ones and those with a NULL, NaN or infinite entry go. Repeated rows and NULL ids stay as they are. Vectors
    of fewer dimensions than ``components`` have a component per dimension. A component without variance (equal vectors, or
    dimensions that depend on others) has ``whitened`` 0 and takes no part in ``identity_error``. Other columns are not read.
    No usable vectors give no rows. Vectors of different lengths, or entries of 2^43 and more, are a ValueError.
    """
    ship_package(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    fields = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vector_col)
    n, least, dim, top = rows.agg(
        F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))
    ).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, {fields}")
    if least != dim:
        raise ValueError(f"vectors of {least} and of {dim} entries have no common covariance")
    if top >= LARGEST:
        raise ValueError(f"an entry of {top} is too large for whole numbers of 1/1024")
    sums = _sums(rows, lambda part: _whole(part, dim), dim, "bigint")
    # whole and remainder apart, so that nothing is lost to the size of the sums
    mean_whole, mean_rest = sums // n, (sums % n) / n

    def centred(part: pa.RecordBatch) -> np.ndarray:
        return (_whole(part, dim) - mean_whole) - mean_rest

    values, axes = spectrum(_covariance(rows, centred, dim, n))
    width = min(components, dim)
    held = values[:width] > dim * EPS * max(values[0], 0)
    scales = np.where(held, 1 / np.sqrt(np.where(held, values[:width], 1)), 0)
    projection = vectors.sparkSession.sparkContext.broadcast(axes[:, :width] * scales)
    trace = float(values.sum())
    explained = (np.maximum(values[:width], 0) / trace if trace > 0 else np.zeros(width)).tolist()

    def whitened(part: pa.RecordBatch) -> np.ndarray:
        return centred(part) @ projection.value

    middle = _sums(rows, whitened, width, "double") / n
    spread = _covariance(rows, lambda part: whitened(part) - middle, width, n)
    error = float(np.abs(spread - np.eye(width))[np.ix_(held, held)].max(initial=0.0))

    def projected(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(parts):
            away = n * (_whole(part, dim) - mean_whole) - (sums % n)
            fits = (away.astype(float) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            deviation = pa.array((away**2).sum(axis=1), mask=~fits)
            made = whitened(part)
            count = part.num_rows
            at = np.repeat(np.arange(count), width)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * width, n)),
                    deviation.take(pa.array(at)),
                    pa.array(made.ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * width, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(projected, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
