import random
import re

from pyspark.sql import functions as F

from popweave.llm import decontaminate


def brute(rows, items, window):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for i, t in rows:
        words, hit, names = cut(t), set(), set()
        for item, text in items:
            w = cut(text)
            for s in range(max(1, len(w) - window + 1)) if w else ():
                part = w[s : s + window]
                for p in range(len(words) - len(part) + 1):
                    if words[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        if item is not None:
                            names.add(str(item))
        out.append((i, len(words), len(hit), sorted(names)))
    return sorted(out, key=str)


def run(spark, docs, items, window=10):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(docs, bench, window=window)
    rows = got.select("doc_id", "n_words", decontaminate.covered().alias("n"), "items").collect()
    return sorted(((r.doc_id, r.n_words, r.n, r["items"]) for r in rows), key=str)


def test_matches_brute_force(spark, documents):
    rnd = random.Random(4)
    vocabulary = ["the", "of", "ÄB", "x1", "é", "日本", "word"]
    item = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([0, 1, 2, 4, 7, 9, 10, 11, 16, 30, 60])] + [(10, "The, of! x1 x1"), (None, item(14)), (99, None)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randrange(6)):
            source = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(len(source) + 1)
            parts += source[a : a + rnd.randrange(25)] + [item(rnd.randrange(12)) + "."]
        rows.append((i, "-".join(parts).upper() if i % 3 else "  ".join(parts)))
    rows += [(100, None), (101, ""), (102, "!!"), (1, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    rows.append((103, " ".join([items[9][1]] * 3000)))
    assert run(spark, documents(rows), items) == brute(rows, items, 10)


def test_other_window_and_filter_collisions(spark, documents, monkeypatch):
    items = [(1, "a b c"), (2, "c d e f")]
    rows = [(1, "x a b c d e f y"), (2, "a b"), (3, "b c d e f")]
    assert run(spark, documents(rows), items, window=3) == brute(rows, items, 3)


def test_empty_tables(spark, documents):
    assert run(spark, documents([]), [(1, "a b")]) == []
    assert run(spark, documents([(1, "a b")]), []) == [(1, 2, 0, [])]


def test_an_items_own_columns_do_not_clash(spark, documents):
    items = spark.createDataFrame([("X77", "one two three four")], "item string, text string").withColumn("id", F.lit(5)).withColumn("t", F.lit("z"))
    got = decontaminate.mark(documents([(1, "zero one two three four five")]), items, window=10, item_id_col="item").collect()
    assert [r["items"] for r in got] == [["X77"]]
