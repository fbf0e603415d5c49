"""Exact byte-pair encoding in linear time, and decoding by an offset table.

For tokenizers with word ends (``</w>``), lower case and dropped white space. An Aho-Corasick automaton gives the longest
token at every position of a word. Tokens are taken from the left, longest first; a token may follow another only if the
merges would have kept the two apart, which a table of pairs answers. Where no token may follow, the last one is taken back and
a shorter one tried, and the position is never visited again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from popweave.llm.texts import map_texts, remembers

END = "</w>"
MEMO = 200_000  # pieces between white space, words, and token pairs that a worker remembers
# Python takes four control characters for white space that Unicode does not
_CONTROL = re.compile("[\x1c-\x1f]")
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]+")


def _category(kind: str) -> str:
    """The inside of a character class with all characters of a Unicode category, by Python's own tables."""
    has = [unicodedata.category(chr(i))[0] == kind for i in range(sys.maxunicode + 1)]
    edges = [i for i in range(len(has)) if has[i] != (i > 0 and has[i - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


# Letters, and capitals with their small letters, that Unicode has and Python 3.13's tables do not.
_NEWER_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7d2\ua7d4\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
    "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3"
    "\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed"
    "\U0001e5f0"
)
_NEWER_SMALL = {
    **{0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB},
    **{0xA7DC: 0x19B},
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

_LETTER, _NUMBER = _category("L") + _NEWER_LETTERS, _category("N")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_WHITE}{_LETTER}{_NUMBER}]+")


class _Memo(dict):
    """Computes what it lacks; when it is full, it forgets what was not asked for since it was last full."""

    def __init__(self, compute):
        self.compute, self.before = compute, {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(0x100)]


class BpeCodec:
    """Codec of one vocabulary file (JSON text). A word is held as a string whose last character is shifted by ``_SHIFT``."""

    _SHIFT = 0x1000

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._byte = byte_characters()
        self._shown = dict(enumerate(self._byte))
        keys: dict[str, str] = {}  # of each token, by its name
        for c in self._byte:
            keys[c], keys[c + END] = c, chr(ord(c) + self._SHIFT)
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = {vocab[t]: (vocab[t], vocab[t]) for t in keys}
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in merges):
            token = vocab[left + right]
            keys[left + right] = keys[left] + keys[right]
            self.merged[vocab[left], vocab[right]] = token
            self.halves.setdefault(token, (vocab[left], vocab[right]))
        by_key = {keys[t]: vocab[t] for t in keys}
        self.size = {i: len(k) for k, i in by_key.items()}
        self.shorter = {i: next((by_key[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in by_key), -1) for k, i in by_key.items()}
        self._automaton = ahocorasick.Automaton()
        for k, i in by_key.items():
            self._automaton.add_word(k, i)
        self._automaton.make_automaton()
        # decoding: token i is names[offsets[i]:offsets[i + 1]]
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        ordered = [names.get(i, "") for i in range(max(names) + 1)]
        self.names = "".join(ordered)
        self.offsets = np.cumsum([0, *map(len, ordered)]).tolist()
        self._pairs = _Memo(self._apart)
        self._words = _Memo(self._encode_word)
        self.pieces = _Memo(self._encode_piece)

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the two tokens side by side.

        Undoes the later of the two merges step by step; a merge across the border that comes before the merge undone last
        would have joined them.
        """
        left, right = pair
        limit = float("inf")
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            undo_left = self.halves[left][0] != left and (left > right or self.halves[right][0] == right)
            if undo_left:
                limit, left = left, self.halves[left][1]
            elif self.halves[right][0] != right:
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def _encode_word(self, word: str) -> tuple[int, ...]:
        # printable ASCII stands for itself
        key = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._shown)
        key = key[:-1] + chr(ord(key[-1]) + self._SHIFT)
        size, shorter, pairs, n = self.size, self.shorter, self._pairs, len(key)
        longest = [-1] * n
        for end, token in self._automaton.iter(key):
            longest[end - size[token] + 1] = token  # a later end is a longer token
        out: list[int] = []
        dead = set()
        at, token = 0, longest[0]
        while at < n:
            after = at + size[token]
            if after not in dead and (not out or pairs[out[-1], token]):
                out.append(token)
                at = after
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def _encode_piece(self, piece: str) -> tuple[bytes, str]:
        ids: list[int] = []
        if piece.isascii() and not (self._cut and self._cut.search(piece)):  # composed, and lower case is a step
            for word in [piece.lower()] if piece.isalpha() else _WORD.findall(piece.lower()):
                ids += self._words[word]
            return array("i", ids).tobytes(), self.decode(ids)
        for part in self._cut.split(piece) if self._cut else [piece]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                part = part if part.isascii() else part.translate(_NEWER_SMALL)
                for word in _WORD.findall(part):
                    ids += self._words[word]
        return np.array(ids, np.int32).tobytes(), self.decode(ids)

    def pieces_of(self, text: str) -> list[tuple[bytes, str]]:
        """Ids, as the bytes of 32-bit integers, and decoded text of every piece between white space."""
        cut = [p for p in _SPACE.split(text) if p] if _CONTROL.search(text) else text.split()
        return list(map(self.pieces.__getitem__, cut))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([ids for ids, _ in self.pieces_of(text)]), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        names, offsets = self.names, self.offsets
        return " ".join([names[offsets[i] : offsets[i + 1]] for i in ids])


_CODECS: dict[int, BpeCodec] = {}
remembers(__name__, _CODECS)


def _codec(sent) -> BpeCodec:
    """The worker's codec of a broadcast vocabulary."""
    if sent.id not in _CODECS:
        _CODECS.clear()
        _CODECS[sent.id] = BpeCodec(sent.value)
    return _CODECS[sent.id]


class _Sent:
    """A broadcast with a name that workers can tell vocabularies apart by."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id, self._sent = hash(text), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self._sent.value


def encode(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
    keep: dict[str, str] | None = None,
) -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and, on demand, ``decoded`` of every row, as the vocabulary's own library gives them.

    ``vocabulary`` is the path of the JSON file on the driver; its content is broadcast (a file of fixed size). No special
    tokens are added; their strings in a text are special tokens. NULL, empty and blank texts have no ids and decode to "".
    A word of any length is encoded in linear time. Rows stay as they are, also under repeated or NULL ids; of
    other columns only those of ``keep`` (new name: old name) come back, in place of ``id_col``.
    """
    sent = _Sent(docs.sparkSession, vocabulary)

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        codec = _codec(sent)
        for text in texts:
            pieces = [p for p in codec.pieces_of(text) if p[0]]
            ids = np.frombuffer(b"".join([p[0] for p in pieces]), np.int32)
            yield (ids, " ".join([p[1] for p in pieces])) if decoded else (ids,)

    return map_texts(docs, keep or {id_col: id_col}, text_col, "ids array<int>" + ", decoded string" * decoded, work)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the token ids, in place of a column of that name; NULL ids decode to ""."""
    rows = rows.drop("decoded")
    sent = _Sent(rows.sparkSession, vocabulary)
    schema = rows.select("*", F.lit("").alias("decoded")).schema

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for part in parts:
            texts = [codec.decode(ids or ()) for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(batches, schema)
