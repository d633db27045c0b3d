"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded by the mean of hashed
embeddings of its words' shapes (case and letter runs collapsed, marks kept) and by a few counts (length, share
of new words, of capitals, of marks, repeats within the passage).  Gated attention weights
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))) are learnt from the documents' labels alone, the document is the
weighted mean of its passages' encodings, and a logistic layer scores it.  Training is Adam in numpy on a
bounded labelled sample (``PER_CLASS`` documents of each class); log-odds are then shifted to the share of
ones among all labelled training rows.

Defined results: null and empty texts are one empty passage; every row comes back, repeated rows too; without
labelled rows the score is the untrained 0.5; an empty table gives an empty result; very long texts are scored whole, passage by
passage; other columns of any name are ignored, and :func:`keep_good` returns them as they are.  Inputs of a score: the text alone.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Adam, held_out, prior_shift, score_documents, sigmoid, training_sample
from .shared import trimmed

PASSAGE = 50
PER_CLASS = 1500
BUCKETS = 1024
EMBEDDING = 12
COUNTS = 6
HIDDEN = 16
GATE = 8
EPOCHS = 12
BATCH = 64
STEPS = 400  # at least so many, however small the sample
CACHE = 300_000

_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+")
_LOWER = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d+")


def shape_of(word: str) -> str:
    """``Word`` -> ``Ax``: runs of capitals, other letters and digits collapse to one sign each."""
    return _DIGIT.sub("0", _LOWER.sub("x", _UPPER.sub("A", word).replace("A", "\x01"))).replace("\x01", "A")


class Features:
    """Words -> one code of shape bucket, length, capitals and marks; cached."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def of(self, word: str) -> int:
        shape = shape_of(word)
        marks = len(shape) - shape.count("A") - shape.count("x") - shape.count("0")
        code = crc32(shape.encode()) % BUCKETS | min(len(word), 20) << 10 | word.isupper() << 15 | min(marks, 4) << 16
        if len(self.cache) < CACHE:
            self.cache[word] = code
        return code

    def passages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, first word of each passage, counts by passage, first passage of each text."""
        cache, of = self.cache, self.of
        codes: list[int] = []
        starts, bags, fresh = [], [], []
        for text in texts:
            bags.append(len(starts))
            words = text.split() or [""]
            for at in range(0, len(words), PASSAGE):
                part = words[at : at + PASSAGE]
                starts.append(len(codes) + at)
                fresh.append(len(set(part)) / len(part))
            codes += [cache[w] if w in cache else of(w) for w in words]
        table, first = np.array(codes, dtype=np.int64), np.array(starts)
        n = np.diff(np.append(first, len(codes))).astype(np.float32)
        share = lambda x: np.add.reduceat(x.astype(np.float32), first) / n
        length, caps, marks = share(table >> 10 & 31), share(table >> 15 & 1), share(table >> 16)
        counts = np.stack([length / 10, caps, marks, np.array(fresh, np.float32), n / PASSAGE, np.ones_like(n)], 1)
        return table & (BUCKETS - 1), first, counts.astype(np.float32), np.array(bags)


class Model:
    """The encoder, the gate and the logistic layer.  Its ``state`` is a plain dict of arrays, which workers without this package can load."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        put = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "E": (0.3 * rng.standard_normal((BUCKETS, EMBEDDING))).astype(np.float32),
            "H": put(EMBEDDING + COUNTS, HIDDEN), "V": put(HIDDEN, GATE), "U": put(HIDDEN, GATE), "a": put(GATE),
            "o": put(HIDDEN), "b": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    @property
    def state(self) -> dict:
        return {"w": self.w, "shift": self.shift}

    @classmethod
    def of(cls, state: dict) -> "Model":
        model = cls.__new__(cls)
        model.w, model.shift = state["w"], state["shift"]
        return model

    def forward(self, buckets, first, counts, bags) -> dict:
        w, n_words, n_bags = self.w, len(buckets), len(bags)
        n = np.diff(np.append(first, n_words))[:, None]
        mean = np.add.reduceat(w["E"][buckets], first, axis=0) / n
        x = np.concatenate([mean, counts], 1)
        h = np.tanh(x @ w["H"])
        t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        bag = np.repeat(np.arange(n_bags), np.diff(np.append(bags, len(first))))
        e = np.exp(e - np.maximum.reduceat(e, bags)[bag])
        att = e / np.add.reduceat(e, bags)[bag]
        z = np.add.reduceat(att[:, None] * h, bags, axis=0)
        return {"n": n, "x": x, "h": h, "t": t, "s": s, "bag": bag, "att": att, "z": z, "y": z @ w["o"] + w["b"][0]}

    def gradients(self, buckets, first, counts, bags, y) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(buckets, first, counts, bags)
        dy = ((sigmoid(f["y"]) - y) / len(y)).astype(np.float32)
        dz = dy[:, None] * w["o"]
        att, bag, h = f["att"], f["bag"], f["h"]
        datt = (dz[bag] * h).sum(1)
        de = att * (datt - np.add.reduceat(att * datt, bags)[bag])
        gate = f["t"] * f["s"]
        dt, ds = de[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * gate * (1 - f["s"])
        dh = (att[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
        dx = dh @ w["H"].T
        dE = np.zeros_like(w["E"])
        per_word = np.repeat(dx[:, :EMBEDDING] / f["n"], f["n"][:, 0], axis=0)
        for k in range(EMBEDDING):
            dE[:, k] = np.bincount(buckets, per_word[:, k], minlength=BUCKETS)
        return {"E": dE, "H": f["x"].T @ dh, "V": h.T @ dt, "U": h.T @ ds, "a": gate.T @ de, "o": f["z"].T @ dy, "b": dy.sum(keepdims=True)}

    def fit(self, texts: list[str], y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 5) -> "Model":
        if not len(y) or y.min() == y.max():
            return self
        rng, features, adam = np.random.default_rng(seed), Features(), Adam(self.w, 0.01)
        ready = [features.passages([t]) for t in texts]
        epochs = max(epochs, -(-STEPS // -(-len(y) // BATCH)))
        for epoch in range(epochs):
            adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.002
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                adam.step(self.gradients(*joined([ready[i] for i in part]), y[part]))
        self.shift = prior_shift(y, share)
        return self

    def scores(self, features: Features, texts: list[str]) -> np.ndarray:
        return sigmoid(self.forward(*features.passages(texts))["y"].astype(np.float64) + self.shift)


def joined(parts: list[tuple]) -> tuple:
    """The passages of several texts as one batch."""
    words = np.cumsum([0] + [len(p[0]) for p in parts])
    passages = np.cumsum([0] + [len(p[1]) for p in parts])
    return (
        np.concatenate([p[0] for p in parts]),
        np.concatenate([p[1] + a for p, a in zip(parts, words, strict=False)]),
        np.concatenate([p[2] for p in parts]),
        np.concatenate([p[3] + a for p, a in zip(parts, passages, strict=False)]),
    )


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, share = training_sample(docs, labels, "quality", per_class, id_col, text_col)
    return Model().fit([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.float32), share)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per input row: id, held_out, score."""
    state = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, id_col, text_col).state)

    def scorer():
        model, features = Model.of(state.value), Features()
        return lambda texts: model.scores(features, texts)

    found = score_documents(docs, scorer, id_col, text_col)
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_score").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    state = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col).state)  # train lowers the batches
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow.compute as pc

        model, features = Model.of(state.value), Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = model.scores(features, [t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pc.greater_equal(scores, least))

    return docs.mapInArrow(trimmed(run), docs.schema)
