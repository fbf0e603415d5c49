import random
import zlib

import numpy as np
import pytest
import xxhash

from popweave.llm import queries, toxicity


def sample(n, seed):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(1, 200))]
        if i % 3 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["Vile!", "rotten", "vile"])
        texts.append(" ".join(words)), toxic.append(int(i % 3 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def network():
    return toxicity.train(*sample(400, 1))


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    live = np.arange(toxicity.WINDOW) < np.array([[5], [toxicity.WINDOW], [1]])
    drives = {d: rnd.standard_normal((3, toxicity.WINDOW, 3 * toxicity.HIDDEN)) for d in "fb"}
    weight = rnd.standard_normal(3)
    total = lambda: float(net.forward(drives, live)[0] @ weight)
    _, held = net.forward(drives, live, keep=True)
    g, dd = net.backward(held, weight)
    for array, grad in [(net.p[k], g[k]) for k in ("Uf", "Ub", "A", "v", "w")] + [(drives[d], dd[d]) for d in "fb"]:
        for _ in range(4):
            at = tuple(rnd.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 1e-4
            up = total()
            array[at] = old - 1e-4
            slope, array[at] = (up - total()) / 2e-4, old
            assert abs(slope - grad[at]) < 1e-3 * max(1, abs(slope))


def test_held_out_accuracy(network):
    texts, toxic = sample(300, 2)
    scores = toxicity.Scorer(network).scores(texts)
    assert ((scores >= 0.7) == np.array(toxic)).mean() > 0.97


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 83, 84, 85, 1000):
        starts = toxicity.windows_of(n)
        assert {p for s in starts for p in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def test_late_word_in_a_long_text_counts(network):
    scorer = toxicity.Scorer(network)
    long = " ".join(["word1 word2"] * 20_000)
    clean, toxic = scorer.scores([long, long + " vile"], block=256)
    assert clean < 0.7 <= toxic


def test_every_part_of_a_run_without_spaces_counts():
    for n in (25, 35, 36, 37, 48, 49, 62, 63, 64, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(f"a {run} b")[1:-1]
        assert {run[i : i + 3] for i in range(n - 2)} <= {p[i : i + 3] for p in pieces for i in range(len(p) - 2)}
        assert max(map(len, pieces)) <= toxicity.PIECE
    assert toxicity.words_of("x" * 24) == ["x" * 24]


def test_one_character_more_changes_the_last_piece_alone():
    run = "".join(chr(0x4E00 + i) for i in range(200))
    for n in range(1, 199):
        shorter, longer = toxicity.words_of(run[:n]), toxicity.words_of(run[: n + 1])
        assert longer[: len(shorter) - 1] == shorter[:-1] and len(longer) - len(shorter) in (0, 1)


def test_toxic_passage_late_in_a_run_without_spaces():
    joined = lambda n, seed: [["_".join(t.split()) for t in part] if i == 0 else part for i, part in enumerate(sample(n, seed))]
    network = toxicity.train(*joined(400, 1))
    run = "_".join(["word1", "word2"] * 60)
    clean, toxic = toxicity.Scorer(network).scores([run, run + "_vile_vile_vile_" + run])
    assert clean < toxic and toxic >= 0.7


def test_rows(spark, documents, network):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word1"), (4, "word1"), (None, "rotten"), (5, "word1 vile"), (6, "é " * 200)]
    got = toxicity.score(documents(rows), network).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert toxicity.score(documents([]), network).count() == 0


def test_without_both_classes_scores_are_equal(spark):
    scores = toxicity.Scorer(toxicity.train(["a b", "c"], [0, 0])).scores(["a", "d e f"])
    assert scores[0] == scores[1]
    assert len(toxicity.Scorer(toxicity.train([], [])).scores(["x"])) == 1


def test_query_on_a_driver_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = [got[r.doc_id].predicted == r.toxic for r in labels]
    assert sum(right) / len(right) > 0.95


def test_slots_are_those_of_each_word_alone():
    rnd = random.Random(12)
    words = ["a", "...", "(ab)", "aaaaaa", "\U0001F600", "日本語", "İ", "<>", "x" * 24]
    words += ["".join(rnd.choice("ab<>é日\U0001F600.,(") for _ in range(rnd.randrange(1, 25))) for _ in range(500)]
    slots = toxicity.Slots.of(words)
    for i, word in enumerate(words):
        bare = word.strip(".,;:!?\"'()[]{}*#$%&|-") or word
        marked = f"<{bare}>"
        grams = sorted({marked[k : k + 3] for k in range(len(marked) - 2)})
        assert slots.words[i] == xxhash.xxh32_intdigest(bare) % toxicity.WORD_SLOTS
        own = slots.grams[slots.starts[i] : slots.starts[i] + slots.counts[i]]
        assert own.tolist() == [xxhash.xxh32_intdigest(g, 1) % toxicity.GRAM_SLOTS for g in grams]
    assert len(toxicity.Slots.of([]).grams) == 0


def test_words_of_many_texts_are_looked_up_together(network, monkeypatch):
    texts = [*sample(60, 4)[0], "", "vile " * 500, "word1"]
    whole, asked = toxicity.Slots.of, []
    monkeypatch.setattr(toxicity.Slots, "of", lambda words: asked.append(len(words)) or whole(words))
    together = toxicity.Scorer(network).scores(texts)
    assert len(asked) == 1
    monkeypatch.setattr(toxicity, "READ", 1)
    assert np.allclose(together, toxicity.Scorer(network).scores(texts, block=3), atol=1e-6)
