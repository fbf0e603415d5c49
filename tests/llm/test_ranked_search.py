import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from popweave.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, k):
    """Every item row's best documents by the formula, one text at a time."""
    counts = [(i, Counter(TERM.findall(lowered(t or "")))) for i, t in docs]
    total, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * total) // length if length else 0
            score = 0
            for t in set(TERM.findall(lowered(text or ""))):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def test_terms_are_the_matches_of_the_pattern():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice("aZ09é日 İK _-@[`{\x7f\x80\n\x00ſ") for _ in range(rnd.randrange(12)))
        assert [t.decode() for t in ranked_search.terms_of(text)] == TERM.findall(lowered(text)), repr(text)


@pytest.mark.parametrize("limits", [(4096, 1_000_000), (3, 1_000_000), (4096, 4)])
def test_ranks_match_brute_force_in_any_blocks(spark, documents, monkeypatch, limits):
    monkeypatch.setattr(ranked_search, "ITEMS", limits[0])
    monkeypatch.setattr(ranked_search, "POSTINGS", limits[1])
    monkeypatch.setattr(ranked_search, "PAIRS", 7)
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("ant Bee cat dog éE Éa 日本 x1 emu".split()) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 9))) for i in range(60)]
    docs += [(7, "ant"), (7, "ant"), (None, "ant cat"), (None, None), (70, None), (71, ""), (72, "... !"), (73, text(30_000))]
    docs += [(100 + i, "emu emu dog") for i in range(15)]  # ties go to the smallest ids
    items = [(i, text(rnd.randrange(1, 6))) for i in range(9)] + [(3, "emu"), (3, "emu"), (None, "bee"), (20, None), (21, ""), (22, "zebra"), (23, "?")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({n: F.lit(1) for n in ("no", "item", "terms", "score", "rank", "n")})
    df = documents(docs).withColumns({n: F.lit(1) for n in ("terms", "tfs", "score", "rank", "no")})
    got = ranked_search.rank(df.repartition(4), asked, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 5)


def test_empty_tables_and_long_items(spark, documents):
    items = spark.createDataFrame([(1, "ant " + " ".join(f"w{i}" for i in range(50_000)))], "item_id long, text string")
    assert ranked_search.rank(documents([]), items).count() == 0
    assert ranked_search.rank(documents([(1, "ant")]), items.limit(0)).count() == 0
    assert ranked_search.rank(documents([(1, None), (2, "-")]), items).count() == 0
    assert [(r.doc_id, r.rank) for r in ranked_search.rank(documents([(1, "ant"), (2, "bee")]), items).collect()] == [(1, 1)]
