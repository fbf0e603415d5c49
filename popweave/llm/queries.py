"""Registered queries of the corpus operators, each over its whole tables with the operator's production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popweave.llm import (
    bpe,
    decontaminate,
    max_entropy,
    neighbours,
    pii,
    quality,
    ranked_search,
    secrets,
    simhash,
    token_counts,
    toxicity,
    url_filters,
    whitening,
)
from popweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose fingerprints over 3-word shingles link at 3 or fewer bits."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, s, k FROM dwin JOIN win USING (k, t)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie inside an occurrence of 10 consecutive words of a benchmark item."""
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = decontaminate.covered()
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query()
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document under the word-end vocabulary and the text they decode to, as digests."""
    rows = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary; the cache is new, so every distinct text is a miss."""
    cache = scratch_path(spark, "token-counts")
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the labels, by a hash of the id, is never learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    net = toxicity.train(*toxicity.training_sample(docs, labels.where(~held_out), "doc_id", "text", "toxic"))
    return toxicity.score(docs, net).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def graded() -> Column:
    """Rating of a label: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document and the probability that it is better than poor, which decides what is kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, graded(), n_grades=3)
    return quality.rate(docs, model, at_least=1).select("*", (F.col("tail") >= 0.5).alias("kept"))


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every document and which of them are secrets."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; the counts and the digest are those of the pattern spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(*pii.training_windows(docs)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    counts = [(F.size(kinds) - n).cast("bigint").alias(f"n_{k}") for k, n in zip(pii.KINDS, counts, strict=True)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


@query()
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by the list, else by association rules mined from what the list has judged."""
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


TERMS_SQL = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"""


@query(
    f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TERMS_SQL} AS term FROM documents) GROUP BY doc_id, term),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM len),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // l) AS m FROM len, corpus),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
asked AS (SELECT DISTINCT item_id, {TERMS_SQL} AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 8 leading whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query()
def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the add-one unigram model and under the maximum-entropy model."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = max_entropy.train(docs.where(~held_out))
    return max_entropy.score(docs.withColumn("held_out", held_out), model, keep={"doc_id": "doc_id", "held_out": "held_out"})
