"""Each stage on a small table against a plain version of its decision."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from popweave.llm import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, near copies, a benchmark passage, secrets, junk, NULLs and empty texts."""
    rnd = random.Random(8)
    path = tmp_path_factory.mktemp("corpus")
    vocabulary = [f"{a}{b}" for a in ("ther", "on", "ing", "ha", "er", "st") for b in ("an", "ou", "ed", "le", "is", "at", "or")]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [prose(120) for _ in range(200)]
    junk = [" ".join(w + rnd.choice(["%%%", "&&&", "###"]) for w in prose(100).split()) for _ in range(100)]
    passage = prose(24)
    near = texts[3].split()
    near[60] = "changed"
    rows = list(enumerate(texts))
    rows += [(1000 + i, t) for i, t in enumerate(junk)]
    rows += [(2000, texts[0]), (2001, " ".join(near)), (2002, f"{prose(40)} {passage} {prose(40)}")]
    rows += [(2003, prose(50) + ' password=0123456789abcdef01 ' + prose(50)), (2004, None), (2005, ""), (None, prose(90)), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i is not None and i < 1080], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, passage


def written(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_in_turn(spark, folder, tmp_path):
    sf_dir, rows, passage = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_filter", "near_dedup", "decontamination", "secret_scan", "bpe_tokens"]

    docs = written(spark, pipeline.quality_filter(spark, docs, sf_dir), f"{tmp_path}/1")
    assert docs.columns == COLUMNS
    kept = [r.doc_id for r in docs.collect()]
    assert not any(i is not None and 1000 <= i < 2000 for i in kept)
    assert {i for i, t in rows if t and (i is None or not 1000 <= i < 2000)} <= set(kept)

    before = docs.collect()
    docs = written(spark, pipeline.near_dedup(spark, docs, sf_dir), f"{tmp_path}/2")
    assert docs.columns == COLUMNS
    left = sorted((r.doc_id for r in docs.collect()), key=str)
    gone = {2000, 2001} | ({2005} if {2004, 2005} <= {r.doc_id for r in before} else set())
    assert left == sorted({r.doc_id for r in before} - gone, key=str)  # each id once: the repeated row went too

    docs = written(spark, pipeline.decontamination(spark, docs, sf_dir), f"{tmp_path}/3")
    assert docs.columns == COLUMNS
    words = b" ".join(decontaminate.words_of(passage)[:10])
    assert {r.doc_id for r in docs.collect()} == {i for i in left if i != 2002}
    assert not any(words in b" ".join(decontaminate.words_of(r.text)) for r in docs.collect())

    same = {r.doc_id: r.text for r in docs.collect()}
    docs = written(spark, pipeline.secret_scan(spark, docs, sf_dir), f"{tmp_path}/4")
    assert docs.columns == COLUMNS
    after = {r.doc_id: r for r in docs.collect()}
    assert after.keys() == same.keys()
    assert "password=[SECRET] " in after[2003].text and after[2003].n_chars == len(after[2003].text)
    assert all(after[i].text == t for i, t in same.items() if i != 2003)

    last = pipeline.bpe_tokens(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id for r in last), key=str) == sorted(after, key=str)
    assert all(r.n_tokens == len(r.ids) for r in last)


def test_run_is_the_stages(spark, folder):
    sf_dir, rows, _ = folder
    got = pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert 195 < got.count() < 210


def test_empty_tables(spark, folder, tmp_path):
    sf_dir = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_row_numbers_do_not_follow_the_splits(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    rows = pipeline._numbered(spark, docs)
    read = lambda: sorted(((r.doc_id, r.text, r[pipeline.ROW]) for r in rows.collect()), key=str)
    before = read()
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        assert read() == before
    finally:
        spark.conf.set(name, old)
    assert len({row for _, _, row in before}) == len(before)
