import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from popweave.llm import shingle_groups, simhash


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Least id of each id's class over exact similarities."""
    sets, least = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 0.8 <= min(len(x), len(y)) / max(len(x), len(y)) and len(x & y) * 5 >= 4 * len(x | y):
            low, high = sorted((least[a], least[b]))
            least = {i: low if v == high else v for i, v in least.items()}
    return least


def corpus():
    """Texts with copies of which a passage or single words are new, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(21)
    rows = []
    for _ in range(120):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([4, 30, 120, 600]))]
        rows.append(" ".join(base))
        for _ in range(3):
            copy, n = list(base), len(base)
            if rnd.random() < 0.5:
                m = int(n * rnd.uniform(0.05, 0.2))
                copy[-m:] = [f"x{rnd.randrange(5000)}" for _ in range(m)] if m else copy[-m:]
            else:
                for _ in range(rnd.randrange(1, 2 + n // 25)):
                    copy[rnd.randrange(n)] = f"y{rnd.randrange(5000)}"
            rows.append(" ".join(copy))
    return list(enumerate(rows + ["", None, " "]))


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup_is_exact(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(shingle_groups, "MEMBERS", 2)
        monkeypatch.setattr(shingle_groups, "SETS", 2)
    rows = corpus()
    expected = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {i for i, v in expected.items() if i == v}


def test_similarity_is_exact_at_the_limit():
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 90), (10, 100), (11, 101))]
    assert shingle_groups._similar(sets)(0, np.array([1, 2])).tolist() == [True, False]


def edited():
    """Long texts, each with a copy in which one word is new, and one with a copy whose last third is."""
    rnd = random.Random(4)
    rows = []
    for _ in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(900)]
        rows += [" ".join(base), " ".join([*base[:-1], "new"])]
    return list(enumerate([*rows, " ".join([*base[:600], *[f"z{i}" for i in range(300)]])]))


def test_near_dedup_searches_fingerprints(spark, monkeypatch):
    """Without the bands, copies within RADIUS bits are still found, and checked exactly."""
    rows = edited()
    links = shingle_groups._links

    def without_bands(held, group, *rest):
        found = links(held, group, *rest)
        return found if group == ["component"] else found.where("false")

    monkeypatch.setattr(shingle_groups, "_links", without_bands)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()}
    prints = {i: simhash._majority(shingle_groups.shingle_set(t, 5)) for i, t in rows}
    near = {b for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3}
    assert near and left == set(prints) - near


def test_fingerprint_links_equal_brute_force(spark):
    rnd = random.Random(6)
    prints = [rnd.getrandbits(64) for _ in range(150)]
    prints += [p ^ sum(1 << i for i in rnd.sample(range(64), n)) for p in prints for n in (0, 2, 3, 4)]
    nodes = [(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(nodes, "node long, fingerprint long")
    least = list(range(len(prints)))

    def joined(a, b):
        low, high = sorted((least[a], least[b]))
        least[:] = [low if v == high else v for v in least]

    for u, v in shingle_groups.fingerprint_links(df, 3).collect():
        joined(u, v)
    found, least[:] = list(least), range(len(prints))
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            joined(a, b)
    assert found == least


def test_only_texts_with_a_loose_link_are_shuffled(spark, monkeypatch):
    """Of 400 texts 3 have a near copy; the others' texts go where they are read, and those that stay are not joined."""
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    rows = list(enumerate(texts + [f"{t} new" for t in texts[:3]]))
    links, moved = shingle_groups._links, []

    def seen(held, group, limit, values, near):
        if group == ["component"]:
            plan = values._jdf.queryExecution().optimizedPlan().toString()
            moved.append((values.count(), "getbit" in plan[plan.index("Join") :]))
        return links(held, group, limit, values, near)

    monkeypatch.setattr(shingle_groups, "_links", seen)
    left = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(400))
    assert moved == [(6, True)]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan[: plan.index("Join")] and "getbit" in plan[plan.index("Join") :]
