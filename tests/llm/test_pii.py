import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_match_the_patterns():
    rnd = random.Random(1)
    pool = ["4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-0100", "a.b@c-d.example", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8"]
    pool += list("0123456789..@@++--  ()ab%é日") + ["@x.y", "a@b", ".com", "000000255", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(14)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "1." * 100_000, "+1 " * 70_000, "1 " * 100_000):
        pii.base_spans(text)


def test_windows_cover_every_mark():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab" * 20 + "1@") for _ in range(rnd.randrange(500)))
        covered = {p for w in pii.windows_of(text) for p in range(w, w + pii.WINDOW)}
        assert all(w % pii.STRIDE == 0 and w < max(1, len(text)) for w in pii.windows_of(text))
        assert {i for i, c in enumerate(text) if c in "1@"} <= covered


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    net = pii.Tagger()
    codes = rnd.integers(0, 128, (3, 9))
    tags = np.array([pii.tags_of([(2, 5, "ip"), (5, 9, "phone")], 0, 9), pii.tags_of([], 0, 9), pii.tags_of([(0, 4, "card")], 0, 9)])
    _, g = net.loss(codes, tags)
    for name, grad in g.items():
        for _ in range(4):
            at = tuple(rnd.integers(0, n) for n in grad.shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = net.loss(codes, tags)[0]
            net.p[name][at] = old - 1e-5
            slope, net.p[name][at] = (up - net.loss(codes, tags)[0]) / 2e-5, old
            assert abs(slope - grad[at]) < 1e-4 * max(1, abs(slope)), name


def test_decoding_is_the_best_path_and_obeys_the_transitions():
    rnd = np.random.default_rng(4)
    net = pii.Tagger()
    net.p["T"] = rnd.standard_normal(net.p["T"].shape)
    e = rnd.standard_normal((4, pii.TAGS))
    trans = net.transitions()
    worth = lambda p: trans[pii.TAGS, p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
    best = max(np.ndindex(*[pii.TAGS] * 4), key=worth)
    assert tuple(net.decode(e)) == best


@pytest.fixture(scope="module")
def halves(spark):
    """Texts to learn from and texts held out, no text in both."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 1
    return docs.where(~held), [r.text for r in docs.where(held & F.regexp_like("text", F.lit("[0-9@]"))).limit(600).collect()]


@pytest.fixture(scope="module")
def network(halves):
    return pii.train(*pii.training_windows(halves[0]))


def found_of(network, texts, truth):
    """By kind: spans there are, and how many of them the network finds by itself, to the character; and all that it finds."""
    found = [set(s) for s in pii.added_spans(network, texts, [[] for _ in texts])]
    there = {k: sum(s[2] == k for t in truth for s in t) for k in pii.KINDS}
    hits = {k: sum(s[2] == k for t, f in zip(truth, found) for s in set(t) & f) for k in pii.KINDS}
    return there, hits, sum(map(len, found))


def test_network_finds_held_out_spans_by_itself(halves, network):
    there, hits, found = found_of(network, halves[1], [pii.base_spans(t) for t in halves[1]])
    assert sum(hits.values()) / sum(there.values()) > 0.9 and sum(hits.values()) / max(1, found) > 0.9


def test_network_finds_held_out_variants_of_each_kind(halves, network):
    rnd = random.Random(6)
    pairs = [pii.variants(t, pii.base_spans(t), rnd) for t in halves[1]]
    there, hits, found = found_of(network, [t for t, _ in pairs], [s for _, s in pairs])
    print("variants", there, hits, found)
    for kind, n in there.items():
        assert n < 10 or hits[kind] / n > 0.5, (kind, n, hits[kind])
    assert sum(hits.values()) / max(1, found) > 0.8


def test_windows_are_reconciled_as_one_decoding_of_their_mean_scores(halves, network):
    """Stretches of overlapping windows, against scores averaged character by character over the whole text."""
    for text in [t for t in halves[1] if len(t) < 1500][:25]:
        n, starts = len(text), pii.windows_of(text)
        sums, counts = np.zeros((n, pii.TAGS)), np.zeros(n)
        for w in starts:
            codes = pii.codes_of(text[w : w + pii.WINDOW])
            e, _ = network.emissions(pii._padded(codes)[None])
            sums[w : w + len(codes)] += e[0, : len(codes)]
            counts[w : w + len(codes)] += 1
        expected, at = [], 0
        while at < n:
            if not counts[at]:
                at += 1
                continue
            end = at
            while end < n and counts[end]:
                end += 1
            tags = network.decode(sums[at:end] / counts[at:end, None])
            expected += [(a + at, b + at, k) for a, b, k in pii.spans_of(tags) if pii._plausible(text[a + at : b + at], k)]
            at = end
        assert pii.added_spans(network, [text], [[]])[0] == expected


def test_rows(spark, documents, network):
    mail, card = "x.1@mail.example.com", "card 4111 1111 1111 1111."
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (None, card), (4, "plain words"), (5, "日 " * 40_000 + mail)]
    got = pii.find(documents(rows), network).collect()
    base = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got), key=str)
    assert base == sorted(((i, [(k, a, b) for a, b, k in brute(t or "")]) for i, t in rows), key=str)
    assert pii.find(documents([]), network).count() == 0
    assert pii.train(*pii.training_windows(documents([(1, "no data"), (2, None)]))) is None
    assert pii.find(documents(rows), None).count() == len(rows)


def test_query_on_a_driver_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op5_personal_data"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    import hashlib

    for i, t in texts.items():
        spans = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[2] == k for s in spans) for k in BASE)
        assert {f"{k}:{a}:{b}" for a, b, k in spans} <= set(got[i].spans.split(","))
