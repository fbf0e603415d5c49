import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from popweave.llm import queries, url_filters

RULES = queries.URL_RULES


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:stop]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en", "https://example.com/en/x?y#z",
    "https://a.www.example.com/en/", "http://xcom/", "http://com/", "http://com", "http://b.com?x=/en/", "http://net/es/1", "http://q.net/fr/",
    "http://q.net/de/", "http://É.com/en/", "ftp://x.net#/es/", "http://a://b.com/", "http://example.com//en/",
]


def test_list_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5]), (3, URLS[5])], "page_id long, url string")
    got = url_filters.judge(rows.withColumn("tokens", F.lit(1)).withColumn("rule", F.lit("x")), RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None and (r.page_id, r.host) != (3, "www.example.com"):
            host, path = brute_parts(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, brute_rule(host, path)), URLS[r.page_id]
        if r.rule:
            assert r.verdict == RULES[r.rule]


def brute_rules(rows, support, confidence):
    """Every antecedent of the labelled rows, pruned as documented."""
    rules = {}
    for v in ("allow", "block"):
        for n in range(1, 4):
            for some in {c for t, _ in rows for c in combinations(sorted(t), n)}:
                held = [x for t, x in rows if set(some) <= set(t)]
                hits = sum(x == v for x in held)
                if hits and hits / len(rows) >= support and hits / len(held) >= confidence:
                    rules[some, v] = (hits / len(held), hits / len(rows))
    return {
        (some, v): c
        for (some, v), c in rules.items()
        if not any(w == v and set(few) < set(some) and d[0] >= c[0] for (few, w), d in rules.items())
    }


def test_mined_rules_and_matching(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(300):
        t = tuple(sorted(rnd.sample("abcde", rnd.randrange(1, 4))))
        rows.append((t, "block" if {"a", "b"} <= set(t) or rnd.random() < 0.1 else "allow"))
    df = spark.createDataFrame([(list(t), v) for t, v in rows], "tokens array<string>, verdict string")
    mined = url_filters.mine(df, 0.02, 0.8)
    expected = brute_rules(rows, 0.02, 0.8)
    assert {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in mined.collect()} == {
        k: (round(c, 9), round(s, 9)) for k, (c, s) in expected.items()
    }
    sets = [list(c) for n in range(1, 6) for c in combinations("abcdez", n)]
    got = url_filters.match(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"), mined)
    best = {}
    for s in sets:
        held = [(round(c, 12), u, len(k), k, v) for (k, v), (c, u) in expected.items() if set(k) <= set(s)]
        if held:
            best[tuple(s)] = max(held)[-1]
    assert {tuple(r.tokens): r.verdict for r in got.collect()} == best


@pytest.mark.parametrize("urls", [[], ["http://x.org/a"]])
def test_nothing_to_learn_from(spark, urls):
    rows = spark.createDataFrame([(1, u) for u in urls], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge(rows, RULES).collect()] == ["allow"] * len(urls)


def test_query_on_a_driver_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = queries.QUERIES["op2_url_filters"](spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = brute_parts(urls[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
