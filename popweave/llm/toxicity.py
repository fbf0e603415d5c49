"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a hashed word vector beside the mean of its hashed character trigram vectors. A text is cut into
overlapping windows; its score is that of its worst window. In training, too, a text is judged by its worst window, so a
label of the whole text teaches the window that holds the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from popweave.llm.texts import map_texts

WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 13
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
WINDOW, STRIDE = 48, 36
SAMPLE_TEXTS = {1: 1_000, 0: 3_000}  # labelled texts of each class that training reads, at most
SAMPLE_WINDOWS = 30_000  # windows of them, at most: further texts of the sample are left out, whole
PIECE = 24  # characters of a word at most; a longer run is read as pieces, each of which overlaps half of the next
MEMO = 150_000  # words whose input a worker remembers
READ = 1 << 16  # words of whole texts whose inputs are looked up together
EMPTY = 0.0  # score of a text without words


def words_of(text: str) -> list[str]:
    """Runs without white space, in overlapping pieces to their end, as of a script without spaces; most runs are one piece."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    half = PIECE // 2
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - half), half)]


def windows_of(n: int) -> np.ndarray:
    """Start of each window over ``n`` words; the last one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Slots:
    """Slots of a list of words: one of each word without outer punctuation, and those of its trigrams between marks of its ends."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.words, self.grams, self.counts = words, grams, counts
        self.starts = np.cumsum(counts) - counts

    @classmethod
    def of(cls, words: list[str]) -> Slots:
        """Trigrams of all words are cut at once; those of a word count once each, by their code points."""
        if not words:
            return cls(*(np.array([], np.int32) for _ in range(3)))
        bare = [w.strip(".,;:!?\"'()[]{}*#$%&|-") or w for w in words]
        own = np.fromiter(map(xxhash.xxh32_intdigest, bare), np.int64, len(bare)) % WORD_SLOTS
        line = np.frombuffer(f"<{'><'.join(bare)}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, bare), np.int64, len(bare))  # as many trigrams, repeats included
        owner = np.repeat(np.arange(len(bare)), sizes)
        at = np.arange(len(owner)) + 2 * owner
        whole, place = np.unique(line[at] << np.uint64(42) | line[at + 1] << np.uint64(21) | line[at + 2], return_inverse=True)
        points = np.stack([whole >> np.uint64(shift) & np.uint64(0x1FFFFF) for shift in (42, 21, 0)], axis=1)
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        slots = np.array([xxhash.xxh32_intdigest(text[i : i + 3], 1) % GRAM_SLOTS for i in range(0, len(text), 3)], np.int32)
        once = np.sort(owner * len(whole) + place)
        once = once[np.flatnonzero(np.diff(once, prepend=-1))]
        counts = np.bincount(once // len(whole), minlength=len(bare))
        return cls(own.astype(np.int32), slots[once % len(whole)], counts.astype(np.int32))

    def take(self, at: np.ndarray) -> Slots:
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return Slots(self.words[at], self.grams[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(counts.sum())], counts)


class Network:
    """Parameters by name; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, seed: int = 11):
        rnd = np.random.default_rng(seed)
        dim = WORD_DIM + GRAM_DIM
        draw = lambda *shape, scale: (rnd.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(WORD_SLOTS, WORD_DIM, scale=0.1), "gram": draw(GRAM_SLOTS, GRAM_DIM, scale=0.1)}
        for d in "fb":
            self.p[f"W{d}"] = draw(dim, 3 * HIDDEN, scale=0.4)
            self.p[f"U{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"A": draw(2 * HIDDEN, ATTENTION, scale=0.4), "v": draw(ATTENTION, scale=0.4)}
        self.p |= {"w": draw(2 * HIDDEN, scale=0.4), "c": np.zeros(1, np.float32)}

    def _steps(self, d: str, drive: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (window, step, unit) in one direction; ``drive`` is what the inputs add to the gates."""
        u, h = self.p[f"U{d}"], np.zeros((len(drive), HIDDEN), np.float32)
        states, kept = np.zeros((*live.shape, HIDDEN), np.float32), []
        k = HIDDEN
        for t in range(live.shape[1]) if d == "f" else reversed(range(live.shape[1])):
            gate = drive[:, t]
            back = h @ u
            both = _sigmoid(gate[:, : 2 * k] + back[:, : 2 * k])
            z, r = both[:, :k], both[:, k:]
            n = np.tanh(gate[:, 2 * k :] + r * back[:, 2 * k :])
            on = live[:, t, None]
            new = np.where(on, (1 - z) * n + z * h, h)
            if keep:
                kept.append((t, h, z, r, n, back[:, 2 * k :], on))
            h = states[:, t] = new
        return states, kept

    def forward(self, drives: dict[str, np.ndarray], live: np.ndarray, keep: bool = False):
        """Logit of each window; ``live`` marks the steps that have a word."""
        halves = {d: self._steps(d, drives[d], live, keep) for d in "fb"}
        h = np.concatenate([halves["f"][0], halves["b"][0]], axis=2)
        u = np.tanh(h @ self.p["A"])
        e = np.where(live, u @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = (a[:, :, None] * h).sum(axis=1)
        logit = pooled @ self.p["w"] + self.p["c"]
        return logit, (halves, h, u, a, pooled, live) if keep else None

    def inputs(self, slots: Slots) -> np.ndarray:
        """Input vector of each word: its own vector beside the mean of its trigrams' vectors."""
        if not len(slots.words):
            return np.zeros((0, WORD_DIM + GRAM_DIM), np.float32)
        sums = np.add.reduceat(self.p["gram"][slots.grams], slots.starts, axis=0)
        return np.concatenate([self.p["word"][slots.words], sums / slots.counts[:, None]], axis=1).astype(np.float32)

    def backward(self, held, grad: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the parameters past the inputs, and of both drives, from that of the logits."""
        halves, h, u, a, pooled, live = held
        g = {"w": pooled.T @ grad, "c": grad.sum(keepdims=True)}
        dp = grad[:, None] * self.p["w"]
        da = (h * dp[:, None]).sum(axis=2)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.tensordot(de, u, axes=([0, 1], [0, 1]))
        du = de[:, :, None] * self.p["v"] * (1 - u * u)
        g["A"] = np.tensordot(h, du, axes=([0, 1], [0, 1]))
        dh = a[:, :, None] * dp[:, None] + du @ self.p["A"].T
        k, drives = HIDDEN, {}
        for i, d in enumerate("fb"):
            back = self.p[f"U{d}"]
            g[f"U{d}"] = np.zeros_like(back)
            drive = np.zeros((*live.shape, 3 * k), np.float32)
            carry = np.zeros((len(live), k), np.float32)
            for t, before, z, r, n, candidate, on in reversed(halves[d][1]):
                total = dh[:, t, i * k : (i + 1) * k] + carry
                dn = total * (1 - z) * (1 - n * n) * on
                dz = total * (before - n) * z * (1 - z) * on
                dr = dn * candidate * r * (1 - r)
                drive[:, t] = np.concatenate([dz, dr, dn], axis=1)
                through = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"U{d}"] += before.T @ through
                carry = np.where(on, total * z, total) + through @ back.T
            drives[d] = drive
            g[f"b{d}"] = drive.sum(axis=(0, 1))
        return g, drives


def _cut(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over one text: word numbers (window, step) and which steps have a word."""
    at = windows_of(len(ids))[:, None] + np.arange(WINDOW)
    live = at < len(ids)
    return ids[np.minimum(at, max(len(ids) - 1, 0))] if len(ids) else np.zeros(at.shape, np.int32), live


def train(
    texts: list[str], toxic: list[int], epochs: int = 8, steps: int = 400, batch: int = 32, rate: float = 0.01, seed: int = 5
) -> Network:
    """Fit on whole texts, ``epochs`` times and for at least ``steps`` steps.

    A text's logit is the largest of its windows; positives weigh as much as negatives in all.
    """
    net, rnd = Network(), np.random.default_rng(seed)
    index: dict[str, int] = {}
    parts = [_cut(np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32)) for t in texts]
    vocabulary = Slots.of(list(index))
    toxic = np.asarray(toxic, np.float32)
    usable = np.array([i for i, (_, live) in enumerate(parts) if live.any()], np.int64)
    if not len(usable) or len(np.unique(toxic[usable])) < 2:
        net.p["w"][:] = 0  # nothing to learn from: one score for all
        return net
    share = toxic[usable].mean()
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    batches = -(-len(usable) // batch)
    epochs = max(epochs, -(-steps // batches))
    step, last = 0, epochs * batches
    for _ in range(epochs):
        drive = _drives(net, net.inputs(vocabulary))
        order = rnd.permutation(usable)
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            ids = np.concatenate([parts[i][0] for i in rows])
            live = np.concatenate([parts[i][1] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(parts[i][0]) for i in rows])
            # the worst window of each text, by the parameters at the epoch's start and then learnt from by those of now
            logit, _ = net.forward({d: drive[d][ids] for d in "fb"}, live)
            worst = np.array([np.flatnonzero(owner == j)[np.argmax(logit[owner == j])] for j in range(len(rows))])
            ids, live = ids[worst], live[worst]
            distinct, place = np.unique(ids, return_inverse=True)
            place = place.reshape(ids.shape)
            slots = vocabulary.take(distinct)
            x = net.inputs(slots)
            now = _drives(net, x)
            logit, held = net.forward({d: now[d][place] for d in "fb"}, live, keep=True)
            grad = (_sigmoid(logit) - toxic[rows]) * weight[rows] / len(rows)
            g, drives = net.backward(held, grad.astype(np.float32))
            dx = np.zeros_like(x)
            for d in "fb":
                by_word = np.zeros((len(distinct), 3 * HIDDEN), np.float32)
                np.add.at(by_word, place.ravel(), drives[d].reshape(-1, 3 * HIDDEN))
                g[f"W{d}"] = x.T @ by_word
                dx += by_word @ net.p[f"W{d}"].T
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], slots.words, dx[:, :WORD_DIM])
            g["gram"] = np.zeros_like(net.p["gram"])
            np.add.at(g["gram"], slots.grams, np.repeat(dx[:, WORD_DIM:] / slots.counts[:, None], slots.counts, axis=0))
            step += 1
            slow = rate * (1 - 0.9 * step / last)
            for k, v in net.p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] * g[k] - second[k])
                v -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def _drives(net: Network, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in "fb"}


class Scorer:
    """Scores whole texts with a trained network; what a word adds to the gates is worked out once and remembered."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self._index: dict[str, int] = {}
        self._drive = {d: np.zeros((MEMO // 8, 3 * HIDDEN), np.float32) for d in "fb"}

    def _numbers(self, words: list[str]) -> np.ndarray:
        index = self._index
        if new := [*({*words} - index.keys())]:
            drive = _drives(self.net, self.net.inputs(Slots.of(new)))
            at = len(self._index)
            for d in "fb":
                while at + len(new) > len(self._drive[d]):
                    self._drive[d] = np.concatenate([self._drive[d], np.zeros_like(self._drive[d])])
                self._drive[d][at : at + len(new)] = drive[d]
            index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str], block: int = 4096) -> np.ndarray:
        """Largest window score of each text; a block of windows is run at a time, so a long text needs no more memory."""
        if len(self._index) > MEMO:
            self._forget()
        out = np.full(len(texts), -np.inf)
        ids, live, owner, held = [], [], [], 0

        def run() -> None:
            all_ids, all_live, who = np.concatenate(ids), np.concatenate(live), np.concatenate(owner)
            for i in range(0, len(all_ids), block):
                part = slice(i, i + block)
                drives = {d: self._drive[d][all_ids[part]] for d in "fb"}
                np.maximum.at(out, who[part], self.net.forward(drives, all_live[part])[0])

        def read() -> None:
            nonlocal ids, live, owner, held
            numbers = self._numbers([w for _, words in waiting for w in words])
            ends = np.cumsum([len(words) for _, words in waiting])
            for (j, _), own in zip(waiting, np.split(numbers, ends[:-1]), strict=True):
                part, on = _cut(own)
                ids.append(part), live.append(on), owner.append(np.full(len(part), j))
                held += len(part)
                if held >= block:
                    run()
                    ids, live, owner, held = [], [], [], 0
            waiting.clear()

        waiting, n = [], 0
        for j, text in enumerate(texts):
            if words := words_of(text):
                waiting.append((j, words))
                n += len(words)
                if n >= READ:
                    read()
                    n = 0
        if waiting:
            read()
        if held:
            run()
        return np.where(np.isfinite(out), _sigmoid(out), EMPTY)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """Texts and labels of at most SAMPLE_TEXTS of their class and SAMPLE_WINDOWS in all, by a hash of the id."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    order = F.xxhash64("k")
    chosen = [marked.where(F.col("y") == y).distinct().orderBy(order, "k").limit(n) for y, n in SAMPLE_TEXTS.items()]
    picked = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "k")
    rows = picked.where("t is not null").orderBy(order, "k", "t").limit(sum(SAMPLE_TEXTS.values()))
    texts, toxic, windows = [], [], 0
    for r in rows.toLocalIterator():
        n = len(windows_of(len(words_of(r.t))))
        if windows + n <= SAMPLE_WINDOWS:
            windows += n
            texts.append(r.t), toxic.append(r.y)
    return texts, toxic


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, sent) -> Scorer:
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(sent.value)
    return _SCORERS[name]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row, from all overlapping windows of its whole text.

    NULL, empty and blank texts score 0. Equal texts score alike; repeated rows and NULL ids stay as they are; other columns
    are not read; an empty table gives no rows. The network (under 1 MB, of fixed size) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    name = xxhash.xxh64_hexdigest(b"".join(v.tobytes() for v in net.p.values()))

    def work(texts: Iterator[str]) -> Iterator[tuple]:
        return ((float(s),) for s in _scorer(name, sent).scores(list(texts)))

    return map_texts(docs, {id_col: id_col}, text_col, "score double", work)
