import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.llm import queries, whitening


def residual(a):
    values, vectors = whitening.spectrum(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-12 * scale
    return np.linalg.norm(a @ vectors - vectors * values) / scale


def test_spectra_of_many_kinds():
    rnd = np.random.default_rng(1)
    for k in (1, 2, 3, 8, 33, 64, 150):
        q = np.linalg.qr(rnd.standard_normal((k, k)))[0]
        for values in (rnd.random(k), np.ones(k), np.r_[np.ones(k // 2), np.zeros(k - k // 2)], 10.0 ** -np.arange(k).clip(max=18), rnd.standard_normal(k), 1 + 1e-9 * rnd.random(k)):
            a = q * values @ q.T
            assert residual((a + a.T) / 2) < 1e-12
    for a in (np.zeros((5, 5)), np.eye(4), np.diag([3.0, 1.0, 2.0]), np.ones((6, 6)), np.array([[0.0, 1.0], [1.0, 0.0]])):
        assert residual(a) < 1e-13


def test_polar_factor_is_the_sign_of_the_matrix():
    a = np.random.default_rng(2).standard_normal((20, 20))
    values, vectors = np.linalg.eigh(a + a.T)
    assert np.abs(whitening.polar_factor(a + a.T) - vectors * np.sign(values) @ vectors.T).max() < 1e-12


def plain(vectors, components):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return deviation, centred @ axes[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def test_query_on_a_driver_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, whitened, explained = plain([r.embedding for r in given], 8)
    got = queries.QUERIES["op12_embedding_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(given) and set(got.n) == {len(given)}
    assert got.deviation[got.component == 1].tolist() == deviation
    mine = got.whitened.to_numpy().reshape(-1, 8)
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened * signs).max() < 1e-9
    assert np.abs(got.explained.to_numpy().reshape(-1, 8) / explained - 1).max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


@pytest.fixture
def table(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        return df.withColumns({n: F.lit("z") for n in ("id", "x", "i", "row", "task", "component", "n", "whitened")})

    return make


def test_rows(table):
    inf, nan = float("inf"), float("nan")
    rnd = np.random.default_rng(4)
    good = [(i if i % 7 else None, rnd.standard_normal(4).tolist()) for i in range(40)]
    good += [good[3], good[3], (500, [0.0] * 4), (501, [9.0, -9.0, 0.5, 1.0])]
    bad = [(600, None), (601, [nan, 1.0, 1.0, 1.0]), (602, [inf, 1.0, 1.0, 1.0]), (603, [None, 1.0, 1.0, 1.0]), (604, [])]
    got = whitening.whiten(table(good + bad).repartition(5)).toPandas()
    deviation, whitened, explained = plain([np.float32(v) for _, v in good], 8)
    assert len(got) == 4 * len(good)  # as many components as dimensions
    assert sorted(got.deviation[got.component == 1]) == sorted(deviation)
    for c in range(4):
        mine = np.sort(got.whitened[got.component == c + 1])
        assert min(np.abs(mine - np.sort(s * whitened[:, c])).max() for s in (1, -1)) < 1e-9
        assert abs(got.explained[got.component == c + 1].iloc[0] - explained[c]) < 1e-12
    assert got.identity_error.max() < 1e-12
    assert got.vec_id.isna().sum() == 4 * sum(i is None for i, _ in good)


def test_tables_without_variance_or_rows(table):
    same = whitening.whiten(table([(i, [0.25, 0.5]) for i in range(9)])).toPandas()
    assert len(same) == 18 and set(same.whitened) == {0.0} and set(same.explained) == {0.0} and set(same.identity_error) == {0.0}
    line = whitening.whiten(table([(i, [i / 4, i / 2]) for i in range(9)])).toPandas()
    assert line.whitened[line.component == 2].abs().max() == 0 and line.identity_error.max() < 1e-12
    assert line.explained[line.component == 1].iloc[0] == pytest.approx(1)
    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([(1, None)])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(table([(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(ValueError):
        whitening.whiten(table([(1, [1e30]), (2, [1.0])]))


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 2.0**30]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows).collect()
    assert len(got) == 4 and all(r.deviation is None for r in got) and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
