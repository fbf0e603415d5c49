import numpy as np
import pyarrow as pa

from popweave.llm import bpe, decontaminate, quality, texts


def test_worker_forgets_what_other_work_has_kept():
    quality.features("some words of a text")
    decontaminate.shingle_hashes([b"some", b"words"], [1])
    bpe._CODECS[0] = None
    texts.turn_to("popweave.llm.quality")
    assert quality._SLOTS and not decontaminate._HASHES and not bpe._CODECS
    texts.turn_to("popweave.llm.shingle_groups")
    assert not quality._SLOTS


def test_workers_turn_to_the_work_they_do(spark):
    docs = spark.createDataFrame([(i, f"word{i} more") for i in range(40)], "doc_id long, text string").coalesce(1)
    model = quality.Ordinal(np.zeros(1 << quality.BITS), np.array([0.0, 1.0]))

    def kept(found):
        for _ in found:
            yield len(quality._SLOTS), len(bpe._CODECS)

    assert quality.rate(docs, model, 1).count() == 40
    kept.__module__ = "popweave.llm.quality"
    texts.map_texts(docs, {}, "text", "a long, b long", kept).collect()
    kept.__module__ = "popweave.llm.shingle_groups"
    seen = texts.map_texts(docs, {}, "text", "a long, b long", kept).collect()
    assert {tuple(r) for r in seen} == {(0, 0)}


def test_long_texts_go_to_workers_a_few_mb_at_a_time(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")
    texts.map_texts(docs, {"id": "id"}, "text", "n long", lambda found: ((len(t),) for t in found)).collect()

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], names=["n"])

    assert max(r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()) < 5_000_000
