"""What the text classifiers share: folds, a bounded training sample, scoring in batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_sample, pruned

FOLDS = 4
HELD_FOLD = 2
SAMPLE_CHARS = 32_000_000  # of the texts that a classifier is fitted on, which the driver holds


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = HELD_FOLD) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, by folds; a null id counts as ''."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def calibration_fold(id_col: str) -> F.Column:
    """Whether a labelled training row is kept from fitting however few there are: every fifth, by crc32 of the id as text."""
    return F.crc32(F.concat(F.lit("cut "), F.col(f"`{id_col}`").cast("string")).cast("binary")) % 5 == 0


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """_id and _y (0 or 1) of the labelled rows that may be learnt from."""
    marked = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y"))
    return marked.where("_id is not null and _y in (0, 1)").where(~held_out("_id"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text", spare: bool = False) -> tuple[list, float]:
    """At most ``per_class`` labelled training rows of each class, chosen by a hash of the id, and the share
    of ones among all labelled training rows.

    Rows are (id, text, label), one for each id (of several texts the one of least hash) and ``SAMPLE_CHARS`` characters in all:
    ids and lengths are read first, and only the texts that fit are then sent.  ``spare`` leaves the calibration fold out.
    """
    marked = training_labels(labels, label, id_col)
    n = marked.agg(*(F.count_if(F.col("_y") == y) for y in (0, 1))).first()
    pool = marked.where(~calibration_fold("_id")) if spare else marked
    zeros, ones = (hash_sample(pool.where(F.col("_y") == y), per_class, n[y], "_id", 11) for y in (0, 1))
    chosen = F.broadcast(zeros.unionAll(ones).groupBy("_id").agg(F.max("_y").alias("_y")))  # at most 2 * per_class pairs of numbers
    rows = pruned(docs, _id=id_col, _text=text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    met = rows.join(chosen, "_id").groupBy("_id", "_y").agg(F.min(F.struct("_h", F.char_length("_text").alias("n"))).alias("m"))
    picked, room = {}, SAMPLE_CHARS
    for r in sorted(met.collect(), key=lambda r: (zlib.crc32(str(r._id).encode()), r._id)):
        if r.m.n <= room:
            picked[r._id] = (r.m._h, r._y)
            room -= r.m.n
    if not picked:
        return [], n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    keys = rows.sparkSession.createDataFrame([(i, h) for i, (h, _) in picked.items()], rows.select("_id", "_h").schema)
    texts = {r._id: r._text for r in rows.join(F.broadcast(keys), ["_id", "_h"]).groupBy("_id").agg(F.min("_text").alias("_text")).collect()}
    return [(i, texts[i], y) for i, (_, y) in picked.items()], n[1] / (n[0] + n[1])


def prior_shift(y: np.ndarray, share: float) -> float:
    """What to add to log-odds learnt on a sample for them to hold at the labelled rows' own share of ones."""
    share, own = (min(max(p, 1e-3), 1 - 1e-3) for p in (share, float(y.mean()) if len(y) else 0.5))
    return float(np.log(share / (1 - share)) - np.log(own / (1 - own)))


def score_documents(docs: DataFrame, score: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "doc_id",
                    text_col: str = "text", keep: tuple[str, ...] = (), batch_chars: int = 1 << 21) -> DataFrame:
    """Rows of _id, _score and the ``keep`` columns; ``score()`` is made once a task and sees bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = score()
        for batch in batches:
            texts, found, start, held = batch.column(1).to_pylist(), [], 0, 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held > batch_chars or i - start >= 1024 or i + 1 == len(texts):
                    found.append(scorer([t or "" for t in texts[start : i + 1]]))
                    start, held = i + 1, 0
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, *batch.columns[2:]], names=names)

    rows = pruned(docs, _id=id_col, _text=text_col, **{c: c for c in keep})
    names = ["_id", "_score", *keep]
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", *keep)]
    schema = f"_id {kinds[0]}, _score double" + "".join(f", `{c}` {k}" for c, k in zip(keep, kinds[1:], strict=True))
    return rows.mapInArrow(run, schema)


class Adam:
    """Adam over a dict of float32 arrays.  A gradient may be (rows, values): then only those rows and their moments move."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        scale = float(self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t))  # a numpy scalar would make doubles of all
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.m[k][at], self.v[k][at]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            if not isinstance(at, slice):
                self.m[k][at], self.v[k][at] = m, v
            self.weights[k][at] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
