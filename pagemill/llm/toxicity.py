"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is read twice: as a word, and as the letter groups (four bytes, with marks at
both ends) that it consists of, whose vectors are pooled by their maximum. Windows
of WINDOW words, STRIDE apart, go through a gated recurrent unit in both directions;
attention pools its states, and a logistic unit scores the window. A text has the
score of its worst window, and every window of the whole text is scored.

Training is in numpy on the driver, over a bounded sample of labelled documents. A
label belongs to a whole text, so the windows of a toxic text that the network
itself finds worst stand for it, and the worst windows of clean texts are the
counterexamples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import hash_sample, received, shipped
from pagemill.llm.decontaminate import words

WINDOW, STRIDE = 24, 16
#: Bounds of the training sample: documents of each class, and characters of a document.
TOXIC_DOCS, CLEAN_DOCS, DOC_CHARS = 1000, 2500, 6000
#: Bounds of the vocabulary, and sizes of the vectors and of the recurrent state.
MAX_WORDS, MAX_GRAMS, DIM, HIDDEN = 30_000, 30_000, 8, 8
EPOCHS, BATCH, RATE = 6, 128, 0.01
#: Words whose inputs a scoring task remembers.
CACHE = 50_000


def grams(word: bytes) -> list[bytes]:
    own = b"^" + word + b"$"
    return [own[i : i + 4] for i in range(max(1, len(own) - 3))]


class Network:
    """Parameters and passes; inputs are (windows, steps) word numbers, 0 for none."""

    def __init__(self, word_numbers: dict[bytes, int], gram_numbers: dict[bytes, int], prior: tuple[np.ndarray, np.ndarray]):
        rng = np.random.default_rng(0)
        self.words, self.grams = word_numbers, gram_numbers
        d, h = 2 * DIM, HIDDEN
        self.p = {
            "word": np.concatenate([prior[0][:, None], rng.normal(0, 0.1, (len(prior[0]), DIM - 1))], 1),
            "gram": np.concatenate([prior[1][:, None], rng.normal(0, 0.1, (len(prior[1]), DIM - 1))], 1),
            "wx": rng.normal(0, d**-0.5, (2, d, 3 * h)),
            "wh": rng.normal(0, h**-0.5, (2, h, 3 * h)),
            "b": np.zeros((2, 1, 3 * h)),
            "wa": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)),
            "va": rng.normal(0, h**-0.5, h),
            "out": rng.normal(0, (2 * h) ** -0.5, 2 * h),
            "bias": np.zeros(1),
        }
        self.p["b"][:, :, :h] = 1  # states are kept at first
        self.p["word"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift = 0.0

    def rows(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its row among the words, and the rows of its letter groups, the first repeated to fill."""
        lists = [[self.grams.get(g, 0) for g in grams(w)] for w in vocabulary]
        wide = np.zeros((len(lists), max(map(len, lists), default=1)), np.int32)
        for i, x in enumerate(lists):
            wide[i] = x[0]
            wide[i, : len(x)] = x
        return np.array([self.words.get(w, 0) for w in vocabulary], np.int64), wide

    def vectors(self, word: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of words, and for each component the letter group that it was pooled from."""
        own = self.p["gram"][wide]
        rows = np.take_along_axis(wide, own.argmax(1), 1)
        return np.concatenate([self.p["word"][word], own.max(1)], 1), rows

    def inputs(self, vocabulary: list[bytes]) -> np.ndarray:
        return self.vectors(*self.rows(vocabulary))[0]

    def forward(self, projected: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers (0: none) into projected inputs (2, words, 3h)."""
        h, (n, steps) = HIDDEN, ids.shape
        mask = (ids > 0).astype(np.float32)
        full = bool(mask.all())
        state, states, kept = np.zeros((2, n, h), np.float32), np.zeros((steps, 2, n, h), np.float32), []
        for t in range(steps):
            a = np.stack([projected[0].take(ids[:, t], 0), projected[1].take(ids[:, steps - 1 - t], 0)])
            u = state @ self.p["wh"]
            gates = 1 / (1 + np.exp(-(a[:, :, : 2 * h] + u[:, :, : 2 * h])))
            z, r = gates[:, :, :h], gates[:, :, h:]
            c = np.tanh(a[:, :, 2 * h :] + r * u[:, :, 2 * h :])
            m = 1 if full else np.stack([mask[:, t], mask[:, steps - 1 - t]])[:, :, None]
            new = state + m * (1 - z) * (c - state)
            if keep:
                kept.append((state, z, r, c, u[:, :, 2 * h :], m))
            state = new
            states[t] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], 2).transpose(1, 0, 2)  # windows, steps, 2h
        q = np.tanh(both @ self.p["wa"])
        e = q @ self.p["va"] + (mask - 1) * 1e4
        e = np.exp(e - e.max(1, keepdims=True))
        w = e / e.sum(1, keepdims=True)
        pooled = (w[:, :, None] * both).sum(1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (kept, both, q, w, pooled)) if keep else logit

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors[None] @ self.p["wx"] + self.p["b"]  # 2, words, 3h

    def gradients(self, ids: np.ndarray, vectors: np.ndarray, label: np.ndarray):
        """Of the mean log loss, for all parameters but the word and letter vectors, and for `vectors`."""
        p, h, (n, steps) = self.p, HIDDEN, ids.shape
        projected = self.project(vectors)
        logit, (kept, both, q, w, pooled) = self.forward(projected, ids, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        d = (1 / (1 + np.exp(-logit)) - label) / n
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()])
        dpool = d[:, None] * p["out"]
        dboth = w[:, :, None] * dpool[:, None, :]
        dw = (both * dpool[:, None, :]).sum(2)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["va"] = np.einsum("ns,nsk->k", de, q)
        dq = de[:, :, None] * p["va"] * (1 - q * q)
        g["wa"] = np.einsum("nsi,nsk->ik", both, dq)
        dboth = dboth + dq @ p["wa"].T
        dx = np.zeros((2, n, steps, 3 * h), np.float32)
        dstate = np.zeros((2, n, h), np.float32)
        for t in reversed(range(steps)):
            dstate = dstate + np.stack([dboth[:, t, :h], dboth[:, steps - 1 - t, h:]])
            state, z, r, c, u, m = kept[t]
            dnew = dstate * m
            dz, dc = dnew * (state - c) * z * (1 - z), dnew * (1 - z) * (1 - c * c)
            dr, du = dc * u * r * (1 - r), dc * r
            dg = np.concatenate([dz, dr, du], 2)
            g["wh"] += state.transpose(0, 2, 1) @ dg
            da = np.concatenate([dz, dr, dc], 2)
            dx[0, :, t], dx[1, :, steps - 1 - t] = da[0], da[1]
            dstate = dstate * (1 - m * (1 - z)) + dg @ p["wh"].transpose(0, 2, 1)
        dproj = np.zeros_like(projected)
        for k in range(2):
            np.add.at(dproj[k], ids.ravel(), dx[k].reshape(-1, 3 * h))
        g["b"] = dproj.sum(1, keepdims=True)
        g["wx"] = vectors.T[None] @ dproj
        return g, (dproj @ p["wx"].transpose(0, 2, 1)).sum(0), logit


def cut(n: int) -> np.ndarray:
    """Where the windows of a text of n words start; the last one ends with the text."""
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW) if n > WINDOW else np.zeros(1, np.int64)


def fit(labelled: list[tuple[str, int]], *, epochs: int = EPOCHS, seed: int = 0) -> Network | None:
    """Train on (text, label) pairs; None where a class is missing."""
    texts = [(words(t), int(y)) for t, y in labelled]
    texts = [(t, y) for t, y in texts if t]
    label = np.array([y for _, y in texts])
    if not len(label) or label.min() == label.max():
        return None
    n = np.array([(label == 0).sum(), (label == 1).sum()])

    def weigh(features, most: int, least: int) -> tuple[dict[bytes, int], np.ndarray]:
        """Numbers of the most frequent features, and how much each speaks for label 1 by its documents."""
        seen = Counter(), Counter()
        for (t, y) in texts:
            seen[y].update(features(t))
        total = seen[0] + seen[1]
        own = sorted((w for w, c in total.items() if c >= least), key=lambda w: (-total[w], w))[:most]
        odds = [np.log((seen[1][w] + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1)) for w in own]
        return {w: i + 1 for i, w in enumerate(own)}, np.array([0, *odds]) / 3

    word_numbers, word_odds = weigh(lambda t: set(t), MAX_WORDS, 2)
    gram_numbers, gram_odds = weigh(lambda t: {g for w in set(t) for g in grams(w)}, MAX_GRAMS, 3)
    net = Network(word_numbers, gram_numbers, (word_odds, gram_odds))
    vocabulary = sorted({w for t, _ in texts for w in t})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    vocabulary = [b"", *vocabulary]
    windows, owner = [], []
    for i, (t, _) in enumerate(texts):
        own = np.array([number[w] for w in t])
        for s in cut(len(own)):
            windows.append(np.pad(own[s : s + WINDOW], (0, max(0, WINDOW - len(own)))))
            owner.append(i)
    windows, owner = np.array(windows), np.array(owner)
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    # Before training, a window's worst word by document counts picks it.
    word, wide = net.rows(vocabulary)

    def all_vectors() -> np.ndarray:
        return np.concatenate([net.vectors(word[i : i + 8192], wide[i : i + 8192])[0] for i in range(0, len(word), 8192)])

    vectors = all_vectors()
    first = np.maximum(vectors[:, 0], vectors[:, DIM])
    first[0] = -9
    worst = first[windows].max(1)
    step = 0
    for _ in range(epochs):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, worst)
        top = worst >= best[owner]
        chosen = top | (rng.random(len(worst)) < 0.1)
        chosen &= (label[owner] == 0) | top
        own = np.nonzero(chosen)[0]
        y = label[owner[own]]
        # As many toxic windows as clean ones.
        own = np.concatenate([own, rng.choice(own[y == 1], max(0, (y == 0).sum() - (y == 1).sum()))])
        rng.shuffle(own)
        for i in range(0, len(own), BATCH):
            some = own[i : i + BATCH]
            used, ids = np.unique(np.append(windows[some], 0), return_inverse=True)  # number 0 stays number 0
            ids = ids[:-1].reshape(len(some), WINDOW)
            vectors, gram_rows = net.vectors(word[used], wide[used])
            g, dv, _ = net.gradients(ids, vectors, label[owner[some]].astype(np.float32))
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], word[used], dv[:, :DIM])
            np.add.at(g["gram"], (gram_rows, np.arange(DIM)[None, :]), dv[:, DIM:])
            g["word"][0] = 0
            step += 1
            for k, x in g.items():  # Adam; rows that a batch doesn't touch stay
                a, b = moments[k]
                at = np.nonzero(np.any(x != 0, axis=1))[0] if k in ("word", "gram") else ...
                a[at] = 0.9 * a[at] + 0.1 * x[at]
                b[at] = 0.999 * b[at] + 0.001 * x[at] ** 2
                net.p[k][at] -= RATE * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.999**step)) + 1e-6)
        projected = net.project(all_vectors())
        worst = np.concatenate([net.forward(projected, windows[i : i + 1024]) for i in range(0, len(windows), 1024)])
    # The cut between the classes that errs on the fewest whole texts, in the middle of its gap.
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, worst)
    order = np.argsort(best)
    ranked, y = best[order], label[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[ranked[0] - 1], (ranked[1:] + ranked[:-1]) / 2, [ranked[-1] + 1]])
    net.shift = float(np.median(edges[errors <= errors.min() + 1e-9]))
    return net


def sample(documents: DataFrame, labels: DataFrame, *, toxic: int = TOXIC_DOCS, clean: int = CLEAN_DOCS, doc_chars: int = DOC_CHARS) -> list[tuple[str, int]]:
    """(text, label) of up to so many documents of each class, those with the smallest id hash.

    documents(doc_id, text), labels(doc_id, label). Ids are chosen from the labels
    alone, twice as many as wanted, and sent to the documents, so no text is dealt out.
    Texts that are null or have over doc_chars characters teach nothing: the three bounds
    limit the sample, while every text is scored whole. Of documents with one id the
    least text counts, of its labels the greatest.
    """
    one = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = []
    for label, n in ((1, toxic), (0, clean)):
        rows = hash_sample(one.where(F.col("label") == label), "doc_id", counts.get(label, 0), 2 * n).collect()
        chosen += [(r["doc_id"], label, i) for i, r in enumerate(rows)]
    ids = documents.sparkSession.createDataFrame(chosen, "doc_id long, label int, i int")
    texts = documents.where(F.length("text") <= doc_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "i").agg(F.min("text").alias("text")).collect()  # 2 * (toxic + clean) ids and texts
    found = sorted(found, key=lambda r: (-r["label"], r["i"]))
    return [(r["text"], 1) for r in found if r["label"] == 1][:toxic] + [(r["text"], 0) for r in found if r["label"] == 0][:clean]


class Scorer:
    """Scores of whole texts; words seen before keep their projected inputs."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known = self.net.project(self.net.inputs([b""]))
        self.used = 1

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        number, new = self.number, []
        ids = []
        for t in texts:
            own = np.empty(len(t), np.int32)
            for i, w in enumerate(t):
                k = number.get(w)
                if k is None:
                    k = number[w] = self.used + len(new)
                    new.append(w)
                own[i] = k
            ids.append(own)
        for i in range(0, len(new), 4096):
            some = self.net.project(self.net.inputs(new[i : i + 4096]))
            if self.used + some.shape[1] > self.known.shape[1]:
                grown = np.zeros((2, self.used + some.shape[1] + CACHE // 2, some.shape[2]), np.float32)
                grown[:, : self.used] = self.known[:, : self.used]
                self.known = grown
            self.known[:, self.used : self.used + some.shape[1]] = some
            self.used += some.shape[1]
        starts = [cut(len(t)) if t else np.empty(0, np.int64) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        # All texts in one row, with room behind each for a short one's window.
        base = np.cumsum([0, *(len(t) + WINDOW for t in texts)])
        flat = np.zeros(base[-1], np.int32)
        for b, own in zip(base, ids, strict=False):
            flat[b : b + len(own)] = own
        at = np.concatenate([s + b for s, b in zip(starts, base, strict=False)]).astype(np.int64) if texts else np.empty(0, np.int64)
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(at), 1024):
            own = flat[at[i : i + 1024, None] + np.arange(WINDOW)]
            np.maximum.at(best, owner[i : i + 1024], self.net.forward(self.known, own))
        if self.used > CACHE:
            self.forget()
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(np.minimum(700, self.net.shift - best))))


def _scores(scorer: Scorer | None, column: pa.Array) -> np.ndarray:
    done, held, size = [np.empty(0)], [], 0
    for text in [*column, None]:
        if text is not None:
            held.append(words(text.as_py()))
            size += len(held[-1])
        if held and (text is None or size > 1 << 16):
            done.append(scorer.of(held) if scorer else np.zeros(len(held)))
            held, size = [], 0
    return np.concatenate(done)


def score(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score, predicted; one row for each row of documents(doc_id, text).

    score: from 0 to 1, the higher the likelier label 1; predicted: 1 from 0.5. Texts
    without words, and null ones, score 0; so do all where nothing could be learned.
    Texts are scored whole, however long, by windows STRIDE words apart that overlap by
    WINDOW - STRIDE. Rows with equal ids are scored by themselves; no documents give no
    rows; other columns are not read.
    """
    shared = shipped(documents.sparkSession, net)  # MAX_WORDS + MAX_GRAMS short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        scorer = Scorer(own) if own else None
        for batch in batches:
            s = _scores(scorer, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(documents: DataFrame, net: Network | None) -> DataFrame:
    """The rows of documents that score under 0.5, as they are, whatever their columns; see score()."""
    shared = shipped(documents.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        scorer = Scorer(own) if own else None
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer, batch.column("text")) < 0.5))

    return documents.mapInArrow(run, documents.schema)


def learn(documents: DataFrame, labels: DataFrame, **bounds: int) -> Network | None:
    """Train on documents(doc_id, text) with labels(doc_id, label); bounds are those of sample()."""
    return fit(sample(documents, labels, **bounds))
