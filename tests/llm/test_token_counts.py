import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from popweave.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = "a the ing ' 's 'll é 日本 <|endoftext|> 42 ... !".split() + [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_add_up(library):
    rnd = random.Random(1)
    with open(PATH, "rb") as f:
        counter = token_counts.Counter("json", f.read())
    assert counter.cuts
    for _ in range(8000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(20)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False)), repr(text)


def test_cache_grows_by_distinct_misses(spark, documents, library, tmp_path):
    cache = str(tmp_path / "counts")
    rows = [(1, "The cat"), (2, "The cat"), (3, None), (4, ""), (None, "x y" * 5000), (2, "The cat")]
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows), key=str)
    for _ in range(2):
        got = token_counts.count_tokens(documents(rows), PATH, cache)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected
        assert spark.read.parquet(cache).count() == 3
    more = token_counts.count_tokens(documents([(9, "new"), (1, "The cat")]), PATH, cache).count()
    assert more == 2 and spark.read.parquet(cache).count() == 4
    assert token_counts.count_tokens(documents([]), PATH, cache).count() == 0


def test_stored_counts_are_used_and_versions_kept_apart(spark, documents, tmp_path):
    cache = str(tmp_path / "counts")
    token_counts.count_tokens(documents([(1, "a b")]), PATH, cache).collect()
    spark.read.parquet(cache).selectExpr("version", "digest", "n_tokens + 100 AS n_tokens").write.parquet(cache + "2")
    assert token_counts.count_tokens(documents([(1, "a b")]), PATH, cache + "2").first().n_tokens == 102
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = token_counts.count_tokens(documents([(1, "a b <s> é"), (2, " a\nb ")]), model, cache + "2").collect()
    piece = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(piece.encode("a b <s> é")), 2: len(piece.encode(" a\nb "))}


def test_query_on_a_driver_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text, add_special_tokens=False))
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len(d.text.encode()), n, n > 512)
