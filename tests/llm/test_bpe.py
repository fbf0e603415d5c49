import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from popweave.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = (
    "a b é Σ ς İ <|endoftext|> <|startoftext|> </w> < w > / 1 ½ 'S 'll 日 本 ǅ ﬁ 🙂 ß ẞ K the ing tion ! ... 0 42"
).split() + [" ", "\n", "\x1c", "\x1f", "\x85", "\xa0", "　", " ", "é", "́", "‍", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.BpeCodec(f.read())


def random_texts(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        yield "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(30)))
        yield "".join(rnd.choice("etaoinshrdlucmfwyp"[: rnd.randrange(2, 19)]) for _ in range(rnd.randrange(1, 80)))


def test_codec_is_the_library(codec, library):
    for text in random_texts(6000, 1):
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character(codec, library):
    texts = [f"a{chr(i)}b {chr(i)}" for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    assert [codec.encode(t).tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_word_takes_linear_time(codec, library):
    for word in ("a" * 200_000, "ab" * 100_000, "!" * 100_000, "the" * 60_000):
        assert codec.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_rows(spark, documents, library):
    rows = list(enumerate(random_texts(100, 2))) + [(1, None), (None, "A b"), (None, "A b"), (900, ""), (901, " \n ")]
    got = bpe.encode(documents(rows), PATH, decoded=True)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)
    back = bpe.decode(got.select("doc_id", "ids"), PATH)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(expected, key=str)
    assert bpe.encode(documents([]), PATH).count() == 0


def test_query_on_a_driver_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op3_bpe_encode_decode"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_memo_keeps_what_is_asked_for(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 4)
    asked = []
    memo = bpe._Memo(lambda key: asked.append(key) or key * 2)
    for key in range(20):
        assert (memo["often"], memo[key]) == ("oftenoften", key * 2)
        assert len(memo) <= 4 and len(memo.before) <= 4
    assert asked.count("often") == 1
