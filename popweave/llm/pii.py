"""Personal data in texts: exact patterns, and a character-level bidirectional LSTM with CRF transitions for their variants.

The network is trained in numpy on windows around labelled spans. A text is cut into overlapping windows; the emissions of
windows that overlap are averaged, and one Viterbi pass over each stretch of them settles all tags together. A span must
hold an "@" or a digit, so windows without either cannot hold one and aren't run.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from popweave.llm.texts import map_texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
WINDOW, STRIDE = 96, 48
CHARACTERS = 131
EMBED, HIDDEN = 8, 12
SAMPLE_TEXTS = 4_000  # texts that training windows are taken from, at most
SAMPLE_WINDOWS = 4_000  # windows that the network is trained on, at most

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# digits that follow a digit can't start an address that the first of them doesn't
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")  # what a window must hold to be looked at
_AT = re.compile(r" ?[(\[]at[)\]] ?")  # an "@" spelled out
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _is_ip(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of every match of the patterns that passes its kind's check, by start, then kind."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        right = _DOMAIN.match(text, at + 1) if start < at else None
        if right:
            found.append((start, right.end(), "email"))
            done = right.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if _is_ip(m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes_of(text: str) -> np.ndarray:
    """ASCII as it is, other letters, other characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) and points.max() < 128:
        return points.astype(np.int64)
    return np.array([p if p < 128 else 128 if chr(p).isalpha() else 129 for p in points.tolist()], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _allowed() -> np.ndarray:
    """Which tag may follow which; the last row is the start. A further character needs one of its kind before it."""
    ok = np.ones((TAGS + 1, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 3):
        rnd = np.random.default_rng(seed)
        self.p = {"E": rnd.standard_normal((CHARACTERS, EMBED)) * 0.5}
        for d in "fb":
            self.p[f"W{d}"] = rnd.standard_normal((EMBED, 4 * HIDDEN)) * 0.4
            self.p[f"U{d}"] = rnd.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.25
            self.p[f"b{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.p["V"] = rnd.standard_normal((2 * HIDDEN, TAGS)) * 0.3
        self.p["c"] = np.zeros(TAGS)
        self.p["T"] = np.zeros((TAGS + 1, TAGS))

    def _run(self, d: str, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
        k, n = HIDDEN, codes.shape[1]
        h = c = np.zeros((len(codes), k))
        states, kept = np.zeros((*codes.shape, k)), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            gate = table[codes[:, t]] + h @ self.p[f"U{d}"]
            s = _sigmoid(gate[:, : 3 * k])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            g = np.tanh(gate[:, 3 * k :])
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh))
            c, h = new, o * tanh
            states[:, t] = h
        return states, kept

    def emissions(self, codes: np.ndarray, keep: bool = False):
        halves = {d: self._run(d, codes, keep) for d in "fb"}
        h = np.concatenate([halves["f"][0], halves["b"][0]], axis=2)
        return h @ self.p["V"] + self.p["c"], (halves, h)

    def transitions(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["T"], -1e4)

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences under the CRF, and its gradients."""
        e, (halves, h) = self.emissions(codes, keep=True)
        b, n, _ = e.shape
        trans = self.transitions()
        step, start = trans[:TAGS], trans[TAGS]
        alpha = np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, n):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
        total = _logsum(alpha[:, -1], 1)
        beta = np.zeros_like(e)
        for t in range(n - 2, -1, -1):
            beta[:, t] = _logsum(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        rows = np.arange(b)[:, None]
        path = e[rows, np.arange(n), tags].sum() + start[tags[:, 0]].sum() + step[tags[:, :-1], tags[:, 1:]].sum()
        de = np.exp(alpha + beta - total[:, None, None])
        g = {"T": np.zeros((TAGS + 1, TAGS))}
        g["T"][TAGS] = de[:, 0].sum(axis=0)
        np.add.at(g["T"][TAGS], tags[:, 0], -1)
        both = alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        g["T"][:TAGS] = np.exp(both).sum(axis=(0, 1))
        np.add.at(g["T"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        g["T"] *= ALLOWED
        de[rows, np.arange(n), tags] -= 1
        g["V"], g["c"] = np.tensordot(h, de, axes=([0, 1], [0, 1])), de.sum(axis=(0, 1))
        dh_all = de @ self.p["V"].T
        k = HIDDEN
        g["E"] = np.zeros_like(self.p["E"])
        for j, d in enumerate("fb"):
            by_code = np.zeros((CHARACTERS, 4 * k))
            g[f"U{d}"] = np.zeros_like(self.p[f"U{d}"])
            dh = dc = np.zeros((b, k))
            for t, before, c, i, f, o, gg, tanh in reversed(halves[d][1]):
                dh = dh + dh_all[:, t, j * k : (j + 1) * k]
                dc = dc + dh * o * (1 - tanh * tanh)
                gates = [dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - gg * gg)]
                dg = np.concatenate(gates, axis=1)
                np.add.at(by_code, codes[:, t], dg)
                g[f"U{d}"] += before.T @ dg
                dh, dc = dg @ self.p[f"U{d}"].T, dc * f
            g[f"W{d}"], g[f"b{d}"] = self.p["E"].T @ by_code, by_code.sum(axis=0)
            g["E"] += by_code @ self.p[f"W{d}"].T
        return float((total.sum() - path) / b), {name: x / b for name, x in g.items()}

    def decode(self, e: np.ndarray) -> list[int]:
        """Best tag sequence over the emissions of one stretch."""
        trans = self.transitions()
        score, back = trans[TAGS] + e[0], np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            step = score[:, None] + trans[:TAGS]
            back[t] = step.argmax(axis=0)
            score = step[back[t], np.arange(TAGS)] + e[t]
        tags = [int(score.argmax())]
        for t in range(len(e) - 1, 0, -1):
            tags.append(int(back[t, tags[-1]]))
        return tags[::-1]


def tags_of(spans: list[Span], start: int, n: int) -> np.ndarray:
    """Tags of ``n`` characters from ``start``; a span that began before goes on as a new one."""
    tags = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k, a, b = KINDS.index(kind), max(a - start, 0), min(b - start, n)
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return tags


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold an "@", spelled out or not, or a digit; together with their neighbours' overlap they cover all of these."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))  # number of the last window
    chosen = set()
    for m in _MARK.finditer(text):
        i = m.start()
        chosen.update(range(max(0, (i - WINDOW) // STRIDE + 1), min(i // STRIDE, last) + 1))
    return [w * STRIDE for w in sorted(chosen)]


def _padded(codes: np.ndarray) -> np.ndarray:
    return np.pad(codes, (0, WINDOW - len(codes)), constant_values=CHARACTERS - 1)


def variants(text: str, spans: list[Span], rnd: random.Random) -> tuple[str, list[Span]]:
    """The text with its spans written in other ways, some as they are, and where they are then."""
    out, places, at = [], [], 0
    for a, b, kind in spans:
        if a < at:
            continue
        value = text[a:b]
        if kind == "phone":
            digits = _digits(value)[-10:]
            ways = [value, "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]
            value = rnd.choice(ways).format(digits[:-7], digits[-7:-4], digits[-4:])
        elif kind == "card":
            digits = _digits(value)
            value = rnd.choice([value, *(sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in ". /")])
        elif kind == "email":
            name, _, host = value.partition("@")
            accented = "".join(rnd.choice("äöüéñß") if c in "aeou" and rnd.random() < 0.3 else c for c in name)
            value = rnd.choice(["{}@{}", "{} [at] {}", "{} (at) {}", "{}[at]{}", "{}(at){}"]).format(rnd.choice([name, accented]), host)
        else:
            value = rnd.choice([value, value.replace(".", ","), value.replace(".", "-"), value.replace(".", " . ")])
        out.append(text[at:a])
        start = sum(map(len, out))
        out.append(value)
        places.append((start, start + len(value), kind))
        at = b
    return "".join(out) + text[at:], places


def train(codes: np.ndarray, tags: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.015) -> Tagger | None:
    """Fit on windows; None without any tagged character."""
    if not len(codes) or not tags.any():
        return None
    net, rnd = Tagger(), np.random.default_rng(1)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, steps + 1):
        rows = rnd.integers(0, len(codes), batch)
        _, g = net.loss(codes[rows], tags[rows])
        size = np.sqrt(sum((x * x).sum() for x in g.values()))
        slow = rate * (1 - 0.9 * t / steps)
        for k, v in net.p.items():
            x = g[k] * min(1, 20 / (size + 1e-9))
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            v -= slow * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return net


def training_windows(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Windows around the labelled spans of at most SAMPLE_TEXTS texts with "@" or a digit, by a hash of the text."""
    rows = docs.select(F.col(text_col).alias("t")).where(F.regexp_like("t", F.lit(_MARK.pattern)))
    rows = rows.withColumn("h", F.xxhash64("t"))
    # hashes alone meet in one task; texts only of those chosen, each once
    chosen = rows.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS)
    rows = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"])

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        for text in texts:
            rnd, parts, labels = random.Random(xxhash.xxh32_intdigest(text)), [], []
            spans = base_spans(text)
            for s, place in ((text, spans), variants(text, spans, rnd)):
                starts = windows_of(s)
                for w in rnd.sample(starts, min(len(starts), 4)):
                    shift = rnd.randrange(STRIDE)  # so that spans lie anywhere in a window
                    w = max(0, min(w + shift, len(s) - WINDOW))
                    part = codes_of(s[w : w + WINDOW])
                    parts.append(_padded(part).tolist())
                    labels.append(np.pad(tags_of(place, w, len(part)), (0, WINDOW - len(part))).tolist())
            yield parts, labels

    made = map_texts(rows, {"h": "h"}, "t", "codes array<array<int>>, tags array<array<int>>", work)
    pairs = made.select("h", F.explode(F.arrays_zip("codes", "tags")).alias("x")).select("h", "x.*")
    table = pairs.orderBy("h", F.xxhash64("codes")).limit(SAMPLE_WINDOWS).select("codes", "tags").toArrow()
    return tuple(np.array(table.column(c).to_pylist(), np.int64).reshape(-1, WINDOW) for c in ("codes", "tags"))


def _plausible(value: str, kind: str) -> bool:
    """The check of a kind, for spans that its pattern doesn't know."""
    digits = _DIGITS.findall(value)
    count = sum(map(len, digits))
    if kind == "email":
        name, _, host = _AT.sub("@", value).rpartition("@")
        return bool(name) and "." in host.strip(".") and not re.search(r"\s", name + host)
    if kind == "ip":
        gaps = set(re.split("[0-9]+", value)[1:-1])
        return len(digits) == 4 and _is_ip(digits) and len(gaps) == 1 and gaps <= {".", ",", "-", " . "} and value[0] in "0123456789"
    if not re.fullmatch(r"[0-9+(][0-9 ()./+-]*[0-9]", value):
        return False
    return 12 <= count <= 19 and luhn("".join(digits)) if kind == "card" else 9 <= count <= 15 and len(digits) > 1


def added_spans(net: Tagger, texts: list[str], known: list[list[Span]], block: int = 256) -> list[list[Span]]:
    """Spans that the network finds in each text beside the known ones, which they don't touch."""
    places = [(i, w) for i, text in enumerate(texts) for w in windows_of(text)]
    out: list[list[Span]] = [[] for _ in texts]
    stretch: tuple[int, int, np.ndarray, np.ndarray] | None = None  # text, start, sums and counts of emissions

    def close() -> None:
        i, start, sums, counts = stretch
        tags = net.decode(sums / counts[:, None])
        for a, b, kind in spans_of(tags):
            a, b = a + start, b + start
            free = all(b <= x or y <= a for x, y, _ in known[i])
            if free and _plausible(texts[i][a:b], kind):
                out[i].append((a, b, kind))

    for s in range(0, len(places), block):
        part = places[s : s + block]
        cut = [codes_of(texts[i][w : w + WINDOW]) for i, w in part]
        emitted, _ = net.emissions(np.stack([_padded(c) for c in cut]))
        for (i, w), c, e in zip(part, cut, emitted, strict=True):
            if stretch is None or stretch[0] != i or w > stretch[1] + len(stretch[2]):
                if stretch is not None:
                    close()
                stretch = (i, w, np.zeros((0, TAGS)), np.zeros(0))
            _, start, sums, counts = stretch
            more = w + len(c) - start - len(sums)
            sums, counts = np.pad(sums, ((0, more), (0, 0))), np.pad(counts, (0, more))
            sums[w - start :] += e[: len(c)]
            counts[w - start :] += 1
            stretch = (i, start, sums, counts)
    if stretch is not None:
        close()
    return out


def spans_of(tags: list[int]) -> Iterator[Span]:
    start, kind = 0, None
    for i, tag in enumerate([*tags, 0]):
        if kind is not None and (tag == 0 or tag % 2 == 1):
            yield start, i, kind
            kind = None
        if tag % 2 == 1:
            start, kind = i, KINDS[tag // 2]


def find(docs: DataFrame, net: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` of every row's whole text: kind, start and end (code points, end exclusive) and ``base``.

    Spans are sorted by start, then kind; those of the patterns are ``base`` and always stay. NULL and empty texts have none.
    Without a network only base spans come back. Repeated rows and NULL ids stay as they are; other columns are not read; an
    empty table gives no rows. The network (some 10 KB, of fixed size) is sent with the work.
    """

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        held = list(texts)
        known = [base_spans(t) for t in held]
        more = added_spans(net, held, known) if net else [[] for _ in held]
        for base, new in zip(known, more, strict=True):
            both = [(*s, True) for s in base] + [(*s, False) for s in new]
            both.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            yield ([{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in both],)

    fields = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return map_texts(docs, {id_col: id_col}, text_col, fields, work)
