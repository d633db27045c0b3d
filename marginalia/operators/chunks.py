"""Chunkers: ranges of sentences (doc_id, chunk, lo, hi), and their texts.

Two forms.  From sentences by rows: ranges are computed on positions alone, and texts join ranges by (doc_id, sentence_idx), an
equi-join, never by range.  From arrays of sentences (:func:`chunk_rows`): hits, ranges and texts are made within the document's
row, without a shuffle; whole runs use this form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import computed
from ..functions.text import anchor_id, anchor_place, chunk_id
from .keywords import pattern_of


def _totals(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total"))


def full_doc(sentences: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One chunk for each document that has sentences."""
    return _totals(sentences).select("doc_id", F.lit(0).alias("chunk"), F.lit(0).alias("lo"), (F.col("total") - 1).alias("hi"))


def keyword_window(sentences: DataFrame, hits: DataFrame, window_sentences: int = 20) -> DataFrame:
    """Windows about hits, clamped to the document; windows that overlap or touch are one."""
    w = window_sentences
    spans = hits.join(_totals(sentences), "doc_id").select(
        "doc_id", F.greatest(F.lit(0), F.col("sentence_idx") - w).alias("lo"), F.least(F.col("total") - 1, F.col("sentence_idx") + w).alias("hi")
    )
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (before.isNull() | (F.col("lo") > before + 1)).cast("int"))
    spans = spans.withColumn("chunk", (F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return spans.groupBy("doc_id", "chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def keyword_per_sentence(sentences: DataFrame, hits: DataFrame) -> DataFrame:
    """A chunk for each hit."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_idx")) - 1
    return hits.select("doc_id", rank.alias("chunk"), F.col("sentence_idx").alias("lo"), F.col("sentence_idx").alias("hi"))


def n_sentence(sentences: DataFrame, hits: DataFrame | None = None, n_sentences: int = 20, stride: int | None = None) -> DataFrame:
    """Windows of n sentences at 0, s, 2s, ...; the last is clipped and the first to reach the end is the last."""
    n, s = n_sentences, n_sentences if stride is None else stride
    totals = _totals(sentences)
    if n <= 0 or s <= 0:
        return totals.where("false").select("doc_id", F.lit(0).alias("chunk"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    starts = F.filter(F.sequence(F.lit(0), F.col("total") - 1, F.lit(s)), lambda x: (x == 0) | (x - s + n < F.col("total")))
    rows = totals.select("doc_id", "total", F.posexplode(starts).alias("chunk", "lo"))
    return rows.select("doc_id", "chunk", "lo", (F.least(F.col("total"), F.col("lo") + n) - 1).alias("hi"))


CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "full_doc": full_doc,
    "keyword_window": keyword_window,
    "keyword_per_sentence": keyword_per_sentence,
    "n_sentence": n_sentence,
}


def chunk_ranges(name: str, sentences: DataFrame, hits: DataFrame | None = None, **params) -> DataFrame:
    """The named chunker's ranges; KeyError for a name that is not registered."""
    return CHUNKERS[name](sentences, hits, **params)


def chunk_texts(ranges: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, chunk_id, lo, hi, sentence_indices, first_anchor, last_anchor, text (sentences by line)."""
    members = ranges.select("doc_id", "chunk", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("sentence_idx"))
    joined = members.join(sentences.select("doc_id", "sentence_idx", "anchor_id", "text"), ["doc_id", "sentence_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("sentence_idx", "anchor_id", "text")))
    rows = joined.groupBy("doc_id", "chunk", "lo", "hi").agg(ordered.alias("m"))
    return rows.select(
        "doc_id", chunk_id(F.col("chunk")).alias("chunk_id"), "lo", "hi", F.col("m.sentence_idx").alias("sentence_indices"),
        F.element_at("m.anchor_id", 1).alias("first_anchor"), F.element_at("m.anchor_id", -1).alias("last_anchor"),
        F.array_join("m.text", "\n").alias("text"),
    )


def _array_ranges(name: str, **params) -> dict[str, str]:
    """Columns that end in ``_r``, the ranges (lo, hi) of a document of ``_n`` sentences with hits at ``_h``; the same as the chunkers above."""
    none = "cast(array() as array<struct<lo:int,hi:int>>)"
    if name == "full_doc":
        return {"_r": "array(named_struct('lo', 0, 'hi', _n - 1))"}
    if name == "keyword_per_sentence":
        return {"_r": "transform(_h, i -> named_struct('lo', i, 'hi', i))"}
    if name == "n_sentence":
        n = params.get("n_sentences", 20)
        s = n if params.get("stride") is None else params["stride"]
        starts = f"filter(sequence(0, _n - 1, {s}), x -> x = 0 or x - {s} + {n} < _n)"
        return {"_r": f"transform({starts}, x -> named_struct('lo', x, 'hi', least(_n, x + {n}) - 1))" if n > 0 and s > 0 else none}
    if name == "keyword_window":
        w = params.get("window_sentences", 20)
        # hits are in order, so a window begins where a hit's does not touch that of the hit before
        first = f"j = 0 or greatest(0, i - {w}) > least(_n - 1, _h[j - 1] + {w}) + 1"
        last = "_h[case when c + 1 < size(_f) then _f[c + 1] - 1 else size(_h) - 1 end]"
        return {
            "_f": f"filter(transform(_h, (i, j) -> case when {first} then j end), j -> j is not null)",
            "_r": f"transform(_f, (j, c) -> named_struct('lo', greatest(0, _h[j] - {w}), 'hi', least(_n - 1, {last} + {w})))",
        }
    raise KeyError(name)


def chunk_arrays(arrays: DataFrame, name: str, keywords: list[str] | None = None, word_boundary: bool = False, **params) -> DataFrame:
    """Documents (doc_id, sentences) that have sentences, with _a (the sentences), _n (how many), _h (the hits' places) and _r (ranges)."""
    df = computed(arrays.select("doc_id", "sentences"), _a="sentences").drop("sentences").where("size(_a) > 0")
    hit = pattern_of(keywords, word_boundary) if keywords and any(k.strip() for k in keywords) else None
    places = F.filter(F.transform("_a", lambda x, i: F.when(x["text"].rlike(hit), i)), lambda i: i.isNotNull()) if hit else "cast(array() as array<int>)"
    return computed(df.withColumn("_n", F.size("_a")), _h=places, **_array_ranges(name, **params))


def chunk_rows(arrays: DataFrame, name: str, keywords: list[str] | None = None, word_boundary: bool = False, **params) -> DataFrame:
    """What :func:`chunk_texts` returns, made within each document's row."""
    df = chunk_arrays(arrays, name, keywords, word_boundary, **params)
    text = "array_join(transform(slice(_a, r.lo + 1, r.hi - r.lo + 1), x -> x.text), '\n')"
    each = df.select("doc_id", F.posexplode(F.expr(f"transform(_r, r -> named_struct('lo', r.lo, 'hi', r.hi, 'text', {text}))")).alias("chunk", "c"))
    return each.select(
        "doc_id", chunk_id(F.col("chunk")).alias("chunk_id"), "c.lo", "c.hi", F.sequence("c.lo", "c.hi").alias("sentence_indices"),
        anchor_id(F.col("c.lo")).alias("first_anchor"), anchor_id(F.col("c.hi")).alias("last_anchor"), "c.text",
    )


def context_window(rows: DataFrame, key: str, order: str, line: str, before: int = 8, after: int = 8) -> DataFrame:
    """Adds ``context``: the lines from ``before`` to ``after`` places about each row, its own marked by '>>'."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-before, after)
    near = F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))).over(w)
    mark = lambda x: F.concat(F.when(x["o"] == F.col(order), ">> ").otherwise("   "), x["l"])
    return rows.withColumn("_near", near).withColumn("context", F.array_join(F.transform("_near", mark), "\n")).drop("_near")


def passage_stretches(passages: DataFrame, sentences: DataFrame) -> DataFrame:
    """Passages (doc_id, passage, start_anchor, end_anchor, topic_summary) as disjoint stretches: doc_id, lo, hi, topic_summary.

    Reversed ends are swapped, passages with unknown ends go, and where passages overlap the last one's summary holds.  A document's
    ends are sorted in its row; between two of them the same passages hold, so that a passage of n sentences is never n rows.
    """
    ends = [anchor_place(F.col(c)) for c in ("start_anchor", "end_anchor")]
    found = passages.select("doc_id", "passage", "topic_summary", *(e.alias(c) for e, c in zip(ends, "ab"))).where("a is not null and b is not null")
    one = F.struct("passage", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "topic_summary")
    last = sentences.groupBy("doc_id").agg(F.max("sentence_idx").alias("_last"))
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_all")).join(last, "doc_id")
    over = "filter(_p, p -> p.lo <= x and x <= p.hi)"
    rows = computed(
        rows, _p="filter(_all, p -> p.hi <= _last)", _x="array_sort(array_distinct(flatten(transform(_p, p -> array(p.lo, p.hi + 1)))))",
        _s=f"filter(transform(_x, (x, j) -> named_struct('lo', x, 'hi', _x[j + 1] - 1, 'p', try_element_at({over}, -1))), s -> s.p is not null)".replace("_x[j + 1]", "get(_x, j + 1)"),
    )
    return rows.select("doc_id", F.explode("_s").alias("s")).select("doc_id", "s.lo", "s.hi", "s.p.topic_summary")


def passage_members(passages: DataFrame, sentences: DataFrame) -> DataFrame:
    """The sentences (a whole index) within passages: doc_id, sentence_idx, topic_summary, anchor_id; see :func:`passage_stretches`."""
    each = passage_stretches(passages, sentences).select("doc_id", F.explode(F.sequence("lo", "hi")).alias("sentence_idx"), "topic_summary")
    return each.withColumn("anchor_id", anchor_id(F.col("sentence_idx")))
