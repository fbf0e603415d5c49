import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.llm import quality, queries


def rated(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        grade = i % 3
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rnd.randrange(5, 80))]
        words[:: 2 + 2 * grade] = ["junk%%%"] * len(words[:: 2 + 2 * grade])
        rows.append((" ".join(words), grade))
    return rows


@pytest.fixture(scope="module")
def model():
    made = [(quality.features(t), g) for t, g in rated(600, 1)]
    return quality.fit([f[0] for f, _ in made], [f[1] for f, _ in made], np.array([g for _, g in made]), 3)


def test_held_out_grades(model):
    expected = [(float(model.tails(t).sum()), g) for t, g in rated(300, 2)]
    assert (np.diff(model.thresholds) > 0).all()
    assert np.mean([round(e) == g for e, g in expected]) > 0.8
    assert np.mean([(model.tails(t)[0] >= 0.5) == (g >= 1) for t, g in rated(300, 3)]) > 0.9


def test_tails_fall_and_no_words_leave_the_thresholds(model):
    for text in ("", "  ", "alpha", "junk%%% " * 100_000):
        tails = model.tails(text)
        assert 0 <= tails[1] <= tails[0] <= 1
    assert np.allclose(model.tails(""), 1 / (1 + np.exp(model.thresholds)))


def test_gradient_fit_raises_the_likelihood():
    made = [(quality.features(t), g) for t, g in rated(200, 4)]
    slots, values, grades = [f[0] for f, _ in made], [f[1] for f, _ in made], np.array([g for _, g in made])

    def likelihood(m):
        above = np.array([m.tails(t) for t, _ in rated(200, 4)])
        upper, lower = np.c_[np.ones(200), above], np.c_[above, np.zeros(200)]
        return np.log(np.maximum(upper - lower, 1e-12)[np.arange(200), grades]).mean()

    marks = [likelihood(quality.fit(slots, values, grades, 3, rounds=r)) for r in (1, 20, 200)]
    assert marks == sorted(marks) and marks[-1] > -0.7


def test_rows(spark, documents, model):
    rows = [(1, None), (2, ""), (3, "alpha"), (3, "alpha"), (None, "junk%%%"), (4, "é " * 50_000)]
    docs = documents(rows).withColumn("tail", F.lit("x")).withColumn("expected_grade", F.lit(7))
    got = quality.rate(docs, model, at_least=1).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert len({(r.tail, r.expected_grade) for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.rate(documents([]), model, at_least=1).count() == 0


def test_training_bounds_and_odd_labels(spark, documents, monkeypatch):
    texts = rated(60, 5)
    docs = documents([(i, t) for i, (t, _) in enumerate(texts)] + [(900, None)])
    ratings = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(texts)] + [(None, 1), (7, None), (8, 9), (900, 0), (999, 1)], "doc_id long, g int")
    assert quality.train(docs, ratings, F.col("g"), 3).weights.any()
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 5)
    few = quality.train(docs, ratings, F.col("g"), 3)
    assert 0 < (few.weights != 0).sum() <= 5 * 30
    assert not quality.train(docs, ratings.limit(0), F.col("g"), 3).weights.any()


def test_query_on_a_driver_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality_classifier"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert np.mean([got[r.doc_id].kept == bool(r.quality) for r in labels]) > 0.97
