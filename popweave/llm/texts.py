"""Row-wise work on whole texts in Arrow batches; all other columns pass through untouched."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from popweave.session import ship_package, small_batches

ROWS = 512  # rows whose results are held before they go back
_KEPT: dict[str, dict] = {}


def remembers(module: str, kept: dict) -> None:
    """``kept`` is what a worker keeps for the work of ``module``."""
    _KEPT[module] = kept


def turn_to(module: str) -> None:
    """A worker lasts from query to query; what it keeps for other work than that of ``module`` is dropped."""
    others = [kept for other, kept in _KEPT.items() if other != module and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()  # some of it refers to itself


def map_texts(
    docs: DataFrame, keep: dict[str, str], text_col: str, fields: str, work: Callable[[Iterator[str]], Iterable[tuple]]
) -> DataFrame:
    """The columns of ``keep`` (new name: old name) and what ``work`` gives for each text, in the order of ``fields``.

    ``work`` gets the texts of one batch, one at a time and "" for NULL, and yields one tuple for each. It is called once a
    batch, so what it should keep for longer belongs to its module, which names it to ``remembers``.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    module = work.__module__
    added = StructType.fromDDL(fields)
    arrow = to_arrow_schema(added)
    kept, own = [F.col(old).alias(new) for new, old in keep.items()], text_col not in keep.values()
    rows = docs.select(*kept, *[F.col(text_col).alias("_text")] * own)
    place = len(kept) if own else [*keep.values()].index(text_col)
    held = len(kept)
    schema = StructType(rows.schema.fields[:held] + added.fields)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(module)
        for part in (whole.slice(i, ROWS) for whole in parts for i in range(0, whole.num_rows, ROWS)):
            texts = (t.as_py() or "" for t in part.column(place))
            made = list(work(texts))
            columns = [pa.array([m[i] for m in made], type=f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*part.columns[:held], *columns], names=schema.names)

    return rows.mapInArrow(batches, schema)
