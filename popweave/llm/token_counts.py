"""Token counts through a table of counts that are already known, keyed by digests of content and tokenizer."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from popweave.llm.texts import map_texts

MEMO = 500_000  # pieces whose count a worker remembers
STORED = "version string, digest binary, n_tokens bigint"
# Python takes four control characters for white space that the tokenizers don't; texts with them aren't cut
_CONTROL = re.compile("[\x1c-\x1f]")
_PIECE = re.compile(r"\s*\S+|\s+")


class Counter:
    """Counts by the vocabulary's own library.

    Byte-level vocabularies join nothing across the place where a word ends and white space begins, so texts are cut there
    and each distinct piece is encoded once.
    """

    def __init__(self, kind: str, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
        self._memo: dict[str, int] = {}
        if kind == "json":
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(content.decode())
            library.no_truncation()
            library.no_padding()
            self.cuts = '"ByteLevel"' in content[:4000].decode(errors="replace") and library.normalizer is None
            self._lengths = lambda texts: map(len, library.encode_batch_fast(texts, add_special_tokens=False))
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.cuts = False
            self._lengths = lambda texts: map(len, library.encode(texts, num_threads=1, add_bos=False, add_eos=False))

    def count(self, text: str) -> int:
        if not self.cuts or _CONTROL.search(text):
            return next(iter(self._lengths([text])))
        pieces, memo = _PIECE.findall(text), self._memo
        if new := [p for p in {*pieces} if p not in memo]:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = [*{*pieces}]
            memo.update(zip(new, self._lengths(new), strict=True))
        return sum(map(memo.__getitem__, pieces))


_COUNTERS: dict[str, Counter] = {}


def _counter(version: str, kind: str, sent) -> Counter:
    if version not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[version] = Counter(kind, sent.value)
    return _COUNTERS[version]


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8, of the text as it is) and ``n_tokens`` of every row.

    ``cache_path`` is a Parquet table in a folder that all executors share. A row's key is the SHA-256 of its normalised
    content beside that of the vocabulary file, so another tokenizer version never meets old counts. Keys without a stored
    count are encoded once each, however many rows have them, and appended; a rerun after a lost driver finds them there.
    Appends by several jobs at once may store a key twice, which changes nothing. NULL counts as "" (0 tokens). Repeated rows
    and NULL ids stay as they are; other columns are not read; an empty table gives no rows. Only ``vocabulary``, a file of
    fixed size, is broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    version, kind = hashlib.sha256(content).hexdigest(), "json" if vocabulary.endswith(".json") else "model"
    sent = spark.sparkContext.broadcast(content)
    spark.createDataFrame([], STORED).write.mode("ignore").parquet(cache_path)

    def stored() -> DataFrame:
        rows = spark.read.schema(STORED).parquet(cache_path).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    content_text = normalise(text)
    distinct = docs.select(_digest(content_text).alias("digest"), content_text.alias("text")).dropDuplicates(["digest"])
    misses = distinct.join(stored().select("digest"), "digest", "left_anti")

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        counter = _counter(version, kind, sent)
        return ((counter.count(t),) for t in texts)

    counted = map_texts(misses, {"digest": "digest"}, "text", "n_tokens bigint", work)
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    rows = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), _digest(content_text).alias("digest")
    )
    return rows.join(stored(), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
