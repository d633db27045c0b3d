"""Toxicity by a convolutional text classifier in numpy.

Words (ASCII white space, A-Z lower-cased, marks at either end cut off) and their first 4 to 7 bytes are hashed
into ``BUCKETS`` each, and every bucket has an embedding of its own.  A word stands for the most telling of its pieces, the one
whose document frequency in the sample tells the classes apart best, by default itself.  Filters of several widths slide over the
whole text, the largest response of each filter is kept, and a logistic layer scores the document.  Since only the
places of the largest responses carry gradient, the backward pass is cheap, and Adam moves the embeddings of those places alone.
One embedding dimension starts at the bucket's smoothed log-odds, the others at small noise; a share ``DROP`` of the words is left out
in each step, so that no document is learnt by its rare words.  Training is Adam on a bounded labelled sample (``PER_CLASS`` of each
class); log-odds are shifted to the share of ones among all labelled training rows.

Thresholds are calibrated by language on the scores of all labelled training rows that the network was not fitted on, a fifth of
them at least, counted by language, label and step of ``GRID`` (the cut that maximises F1 in that language, shrunk towards the
common cut by ``SHRINK`` pseudo-documents).  The score itself never sees the language.

Defined results: null and empty texts have no words and get the score of all-padding input; every row comes
back, repeated rows too; a language without labelled rows, null included, uses the common cut; without
labelled rows the score is the untrained 0.5 and the cut ``CUT``; an empty table gives an empty result; very long texts are scored
whole; other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Adam, held_out, prior_shift, score_documents, sigmoid, training_labels, training_sample
from .shared import fresh, stored

BUCKETS = 1 << 16
EMBEDDING = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PER_CLASS = 2000
LEAST_DOCS = 3  # a bucket of fewer documents starts nearer to nothing
DROP = 0.1
PIECES = (4, 5, 6, 7)
EPOCHS = 6
BATCH = 64
STEPS = 400  # at least so many, however small the sample
CUT = 0.3
SHRINK = 20
GRID = np.linspace(0.05, 0.95, 19)
CACHE = 400_000
MARKS = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def pieces_of(word: bytes) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    bare = word.strip(MARKS) or word
    return [crc32(bare) % BUCKETS, *(BUCKETS + crc32(bare[:k]) % BUCKETS for k in PIECES if k < len(bare))]


class Words:
    """Words -> embedding rows, cached; row 0 is padding, row 1 + b is bucket b."""

    def __init__(self, telling: np.ndarray):
        self.telling, self.cache = telling, {}

    def of(self, word: bytes) -> int:
        pieces, telling = pieces_of(word), self.telling
        row = 1 + max(pieces, key=telling.__getitem__)  # of equals the first, which is the word itself
        if len(self.cache) < CACHE:
            self.cache[word] = row
        return row

    def text(self, text: str) -> list[int]:
        cache, of = self.cache, self.of
        return [cache[w] if w in cache else of(w) for w in text.encode().lower().split()]


class Model:
    """Embeddings, filters and the logistic layer.  Its ``state`` is a plain dict of arrays, which workers without this package can load."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.telling = np.zeros(2 * BUCKETS, np.float32)
        wide = sum(WIDTHS)
        self.w = {
            "E": np.zeros((1 + 2 * BUCKETS, EMBEDDING), np.float32),
            "K": (rng.standard_normal((EMBEDDING, wide * FILTERS)) / np.sqrt(EMBEDDING)).astype(np.float32),
            "c": np.zeros(len(WIDTHS) * FILTERS, np.float32),
            "o": (0.3 * rng.standard_normal(len(WIDTHS) * FILTERS)).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.shift, self.cuts, self.cut = 0.0, {}, CUT
        self.tables: list[np.ndarray] | None = None

    @property
    def state(self) -> dict:
        return {"w": self.w, "telling": self.telling, "shift": self.shift}

    @classmethod
    def of(cls, state: dict) -> "Model":
        model = cls.__new__(cls)
        model.w, model.telling, model.shift = state["w"], state["telling"], state["shift"]
        model.tables = model.responses()
        return model

    def responses(self, rows: np.ndarray | None = None) -> list[np.ndarray]:
        """The responses of all embeddings, or of some, to the filters, by filter column."""
        table = (self.w["E"] if rows is None else self.w["E"][rows]) @ self.w["K"]
        return [np.ascontiguousarray(table[:, c * FILTERS : (c + 1) * FILTERS]) for c in range(sum(WIDTHS))]

    def features(self, ids: list) -> dict:
        """Pooled responses of a batch: texts are laid end to end with padding between them."""
        gap = max(WIDTHS) - 1
        n = np.array([max(1, len(x)) for x in ids])
        starts = np.concatenate([[0], np.cumsum(n + gap)[:-1]])
        rows = np.zeros(int((n + gap).sum()), dtype=np.int64)
        for s, x in zip(starts, ids, strict=True):
            rows[s : s + len(x)] = x
        # each row's responses to every filter column, once; then a place's response is a sum of few of them
        tables, met, at = self.tables, None, rows
        if tables is None:  # in training: of the rows that the batch has
            met, at = np.unique(rows, return_inverse=True)
            tables = self.responses(met)
        pooled, place, col = [], [], 0
        for i, width in enumerate(WIDTHS):
            total = None
            for j in range(width):
                part = tables[col].take(at[j : len(at) - gap + j], axis=0)
                total = part if total is None else np.add(total, part, out=total)
                col += 1
            # padding between texts: windows start within a text, so cut the places of the gap
            bounds = np.stack([starts, starts + n], 1).ravel()
            pooled.append(np.maximum.reduceat(total, bounds[:-1], axis=0)[::2])  # the last text ends where total does
            place.append(total)
        x = np.concatenate(pooled, 1) + self.w["c"]
        return {"x": np.maximum(x, 0), "rows": rows, "starts": starts, "n": n, "responses": place, "top": pooled}

    def logits(self, f: dict) -> np.ndarray:
        return f["x"] @ self.w["o"] + self.w["b"][0]

    def gradients(self, ids: list[list[int]], y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.features(ids)
        dy = ((sigmoid(self.logits(f)) - y) / len(y)).astype(np.float32)
        dx = dy[:, None] * w["o"] * (f["x"] > 0)
        dK, col, rows_met, parts = np.zeros_like(w["K"]), 0, [], []
        for i, width in enumerate(WIDTHS):
            own = dx[:, i * FILTERS : (i + 1) * FILTERS]
            at = np.stack([
                s + np.argmax(f["responses"][i][s : s + m], axis=0) for s, m in zip(f["starts"], f["n"], strict=True)
            ])  # the place of each text's largest response to each filter
            for j in range(width):
                rows = f["rows"][at + j]
                K = w["K"][:, (col + j) * FILTERS : (col + j + 1) * FILTERS]
                dK[:, (col + j) * FILTERS : (col + j + 1) * FILTERS] += np.einsum("bfe,bf->ef", w["E"][rows], own)
                rows_met.append(rows.ravel())
                parts.append((own[:, :, None] * K.T[None]).reshape(-1, EMBEDDING))
            col += width
        met, place = np.unique(np.concatenate(rows_met), return_inverse=True)
        values = np.concatenate(parts)
        dE = np.stack([np.bincount(place, values[:, e], minlength=len(met)) for e in range(EMBEDDING)], 1).astype(w["E"].dtype)
        dE[met == 0] = 0  # padding stays at zero
        return {"E": (met, dE), "K": dK, "c": dx.sum(0), "o": f["x"].T @ dy, "b": dy.sum(keepdims=True)}

    def fit(self, texts: list[str], y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 2) -> "Model":
        if not len(y) or y.min() == y.max():
            return self
        rng = np.random.default_rng(seed)
        seen = np.zeros((2, 2 * BUCKETS), dtype=np.float32)
        for text, label in zip(texts, y, strict=True):
            seen[int(label), list({p for w in set(text.encode().lower().split()) for p in pieces_of(w)})] += 1
        n = seen.sum(0)
        odds = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / ((1 - y).sum() + 2))
        odds *= np.minimum(1, n / LEAST_DOCS) * (n > 0)
        self.telling = (np.abs(odds) * np.sqrt(n) * (n >= LEAST_DOCS)).astype(np.float32)
        words = Words(self.telling)
        ids = [np.array(words.text(t), np.int64) for t in texts]
        E = (0.1 * rng.standard_normal(self.w["E"].shape)).astype(np.float32)
        E[1:][n < LEAST_DOCS] = 0  # hardly met in the sample: what there is to know is the odds
        E[1:, 0], E[0] = odds, 0
        self.w["E"] = E
        self.w["K"][0, :] = np.abs(self.w["K"][0, :])
        self.w["o"] = np.abs(self.w["o"])
        adam = Adam(self.w, 0.01)
        epochs = max(epochs, -(-STEPS // -(-len(y) // BATCH)))
        for epoch in range(epochs):
            adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.002
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                adam.step(self.gradients([ids[i][rng.random(len(ids[i])) >= DROP] for i in part], y[part]))
        self.shift, self.tables = prior_shift(y, share), self.responses()
        return self

    def calibrate(self, counts: Iterable[tuple[str | None, int, int, int]]) -> None:
        """Cuts from (language, label, how many of GRID the score reaches, rows)."""
        by: dict[str | None, np.ndarray] = {}
        for lang, label, step, n in counts:
            by.setdefault(lang, np.zeros((2, len(GRID) + 1)))[label, step] += n
        total = sum(by.values(), np.zeros((2, len(GRID) + 1)))
        self.cut, self.cuts = CUT, {}
        if not total.sum(1).all():
            return

        def best(own: np.ndarray) -> float:
            flagged = own[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # rows of each label whose score reaches each cut
            f1 = 2 * flagged[1] / np.maximum(1.0, own[1].sum() + flagged.sum(0))
            top = np.flatnonzero(np.isclose(f1, f1.max()))
            return float(GRID[top[np.argmin(np.abs(GRID[top] - CUT))]])  # of equal cuts the one next to CUT

        self.cut = best(total)
        for lang in sorted(x for x in by if x is not None):
            n = int(by[lang].sum())
            self.cuts[lang] = (n * best(by[lang]) + SHRINK * self.cut) / (n + SHRINK)

    def of_ids(self, ids: list[list[int]]) -> np.ndarray:
        return sigmoid(self.logits(self.features(ids)).astype(np.float64) + self.shift)

    def scores(self, words: Words, texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 32):  # bounds the responses held at once
            out.append(self.of_ids([words.text(t) for t in texts[at : at + 32]]))
        return np.concatenate(out)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   per_class: int = PER_CLASS) -> DataFrame:
    """One row per input row: id, held_out, score, lang_cut, flagged (score at least the language's cut)."""
    rows, share = training_sample(docs, labels, "toxic", per_class, id_col, text_col, spare=True)
    fitted = Model().fit([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.float32), share)
    spark = docs.sparkSession
    state = spark.sparkContext.broadcast(fitted.state)

    def scorer():
        model = Model.of(state.value)
        words = Words(model.telling)
        return lambda texts: model.scores(words, texts)

    (lang,) = fresh(docs, "_lang")
    found = score_documents(docs.withColumn(lang, F.col(f"`{lang_col}`")), scorer, id_col, text_col, keep=(lang,)).withColumnRenamed(lang, "_lang")
    found = stored(found, "scores")  # two consumers: the cuts and the rows themselves
    own = training_labels(labels, "toxic", id_col)
    used = spark.createDataFrame([(r[0],) for r in rows], own.select("_id").schema)
    marked = own.join(F.broadcast(used), "_id", "left_anti").withColumnRenamed("_id", "_lid")  # used: at most 2 * per_class ids
    step = sum((F.col("_score") >= float(c)).cast("int") for c in GRID)
    counts = found.join(marked, F.col("_id") == F.col("_lid")).groupBy("_lang", "_y", step.alias("_step")).count()
    fitted.calibrate((r._lang, r._y, r._step, r["count"]) for r in counts.collect())  # at most 40 rows a language
    cut = F.lit(fitted.cut)
    for lang, value in fitted.cuts.items():
        cut = F.when(F.col("_lang") == lang, value).otherwise(cut)
    return found.select(
        F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_score").alias("score"),
        cut.alias("lang_cut"), (F.col("_score") >= cut).alias("flagged"),
    )
