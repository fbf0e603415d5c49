import random
from itertools import combinations

import pytest
import xxhash

from popweave.llm import simhash
from popweave.llm.components import connected_components


def brute_fingerprint(text, k):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    least = dict(zip(ids, ids, strict=True))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, x), (b, y) in combinations(zip(ids, prints, strict=True), 2):
        if (x ^ y).bit_count() <= radius:
            a, b = sorted((root(a), root(b)))
            least[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_difference(radius):
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rnd = random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(m & diff == 0 for m in masks)


def test_no_mask_keeps_few_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(6)]
    assert min(m.bit_count() for m in masks) >= 20
    rnd = random.Random(6)
    assert all(any(m & diff == 0 for m in masks) for diff in (sum(1 << b for b in rnd.sample(range(64), 6)) for _ in range(3000)))


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Äther", "ÉTÉ", "The"]
    out = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 5, 40, 400]))]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            if copy:
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append("\n".join(copy) + "\x0b")
    return out


def test_groups_match_brute_force(spark, documents):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(150, 5))] + [(2000, None), (2001, ""), (2002, " \t"), (2003, "x " * 200_000)]
    got = {r.doc_id: r for r in simhash.simhash_groups(documents(rows)).collect()}
    prints = {i: brute_fingerprint(t, 3) for i, t in rows}
    expected = brute_components(list(prints), list(prints.values()), 3)
    assert {i: r.fingerprint & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == expected


def test_hot_bucket_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) & ~0xFFFF00 | rnd.getrandbits(10) << 8 for _ in range(5)}
    prints |= {0xABCD << 40 | rnd.getrandbits(12) for _ in range(300)}
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "node long")
    rows = rows.selectExpr("node", "node AS fingerprint", "unhex('') AS sketch")
    edges = simhash.bucket_edges(rows, 3)
    got = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in connected_components(edges).collect()}
    expected = brute_components(list(prints), list(prints), 3)
    classes = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert classes({p: got.get(p, p) for p in prints}) == classes(expected)


def test_repeats_nulls_and_empty(spark, documents):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u v"), (5, "A b  c d")]
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.simhash_groups(documents(rows)).collect()), key=str)
    assert got == [("1", 1), ("1", 1), ("5", 1), ("None", 1), ("None", None)]
    assert simhash.simhash_groups(documents([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_sketch_confirms_similarity(spark, documents):
    rnd = random.Random(9)
    base = [f"t{rnd.randrange(10**6)}" for _ in range(300)]
    near = base[:]
    near[150] = "other"
    shuffled = base[:]
    rnd.shuffle(shuffled)  # the same words, so the same first fingerprint, but no common shingle
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(shuffled))]
    got = simhash.simhash_groups(documents(rows), shingle=1, radius=6, distinct=True, sketch_lanes=4, sketch_bits=39)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}
