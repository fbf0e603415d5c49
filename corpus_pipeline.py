"""Corpus cleaning in stages; each stage works on all that the stage before it kept.

Rows are told apart by a row number, so repeated rows, repeated doc_ids and NULL doc_ids are each decided for themselves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from popweave.llm import bpe, decontaminate, quality, secrets, shingle_groups
from popweave.llm.queries import graded, table
from popweave.operators.joins import without_members
from popweave.session import cut_lineage, scratch_path

ROW = "_pipeline_row"


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """With a row number, written once and read again.

    A number worked out at each reading would follow how the table is dealt over tasks, which changes with the executors at hand.
    """
    path = scratch_path(spark, "rows")
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return without_members(rows, ROW, cut_lineage(gone)).drop(ROW)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely poor than not go; a text without words stays or goes by the thresholds alone.

    The classifier learns from the labelled documents of the corpus as it came in.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), graded(), n_grades=3)
    keep = {f"column_{i}": c for i, c in enumerate(docs.columns)}
    rated = quality.rate(docs, model, at_least=1, keep=keep).where("tail >= 0.5")
    return rated.select(*[F.col(new).alias(old) for new, old in keep.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least doc_id, then the first row.

    Documents are linked if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more. Candidates are SimHash
    fingerprints over those shingles within 3 bits, and pairs of min-hash bands, as at 0.8 fingerprints differ in more bits.
    """
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(ROW).alias("c"))
    rows = _numbered(spark, docs)
    keyed = rows.select(order.alias("k"), "text")
    groups = shingle_groups.shingle_groups(keyed, "k", "text", shingle=5)
    gone = groups.where(F.col("k.c") != F.col("component_id.c")).select(F.col("k.c").alias(ROW))
    return _without(rows, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item, or a whole shorter item, go."""
    rows = _numbered(spark, docs)
    marked = decontaminate.mark(rows, table(spark, sf_dir, "benchmark"), id_col=ROW, window=10)
    return _without(rows, marked.where(F.size("spans") > 0).select(ROW))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark and its length is counted anew."""
    rows = _numbered(spark, docs)
    clean = secrets.redact(rows, secrets.scan(rows, id_col=ROW), id_col=ROW)
    changed = clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean
    return changed.select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    keep = {c: c for c in ("doc_id", "lang", "source")}
    rows = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=keep)
    return rows.select(*keep, F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_tokens", bpe_tokens),
]

# Models, fingerprints and merges are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
