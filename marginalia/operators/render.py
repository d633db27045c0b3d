"""Tables behind a document view: paragraphs in tokens, cards and rows in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import computed, running_starts
from ..functions.text import anchor_id, coder_name
from .sentences import sentence_arrays

FAR = 10**9
PIECE = 256
# The view's classes of anchors by source.
SOURCE_CLASS = {
    "ai": "source-ai", "coder_a": "source-coder-a", "coder_b": "source-coder-b", "coders_both": "source-coders-both",
    "ai_and_a": "source-ai-and-a", "ai_and_b": "source-ai-and-b", "ai_and_both": "source-ai-and-both",
}


def _paragraph_arrays(docs: DataFrame, separator: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _text and _paras, the non-empty stretches between separators as an array of (a, b)."""
    df = computed(
        docs.select(F.col(id_col).alias("doc_id"), F.expr(f"coalesce({text_col}, '')").alias("_text")),
        _p=f"split(regexp_replace(_text, r'({separator})', '\x01$1\x01'), '\x01')",
        _n="transform(_p, x -> char_length(x))",
        _s=running_starts("_n"),
        _paras="filter(transform(_p, (x, i) -> named_struct('a', _s[i], 'b', _s[i] + _n[i], 'odd', i % 2)), x -> x.odd = 0 and x.b > x.a)",
    )
    return df.select("doc_id", "_text", "_paras")


def paragraphs(docs: DataFrame, separator: str = r"\n{2,}", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, para_idx, p_start, p_end of the non-empty stretches between separators."""
    rows = _paragraph_arrays(docs, separator, id_col, text_col).select("doc_id", F.posexplode("_paras").alias("para_idx", "p"))
    return rows.select("doc_id", "para_idx", F.col("p.a").alias("p_start"), F.col("p.b").alias("p_end"))


def paragraph_tokens(docs: DataFrame, sentences: DataFrame | None = None, sources: DataFrame | None = None, separator: str = r"\n{2,}",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, para_idx, token_idx, is_sentence, anchor_id, text, source_class.

    Each sentence comes once, in the first paragraph it overlaps, clipped to it; what lies between is plain text.  All is made within the
    document's row: paragraphs' ends and sentences' starts are sorted together, so that a sentence's place in that order tells how many
    paragraphs end before it.  Without ``sentences`` they are cut from the text in the same row; those by row (no text is read) join the
    documents by id.  Tokens are cut from pieces of ``PIECE`` code points, so that a long document stays linear.
    """
    rows = _paragraph_arrays(docs, separator, id_col, text_col)
    if sentences is None:
        rows = computed(sentence_arrays(rows, "doc_id", "_text", ("_text", "_paras")), _s="transform(sentences, (x, i) -> named_struct('a', x.char_start, 'b', x.char_end, 'i', i))").drop("sentences")
    else:
        own = F.array_sort(F.collect_list(F.struct(F.col("char_start").alias("a"), F.col("char_end").alias("b"), F.col("sentence_idx").alias("i"))))
        spans = sentences.groupBy("doc_id").agg(own.alias("_s"))
        rows = rows.join(spans, "doc_id", "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<a:int,b:int,i:int>>")))
    rows = computed(
        rows,
        _e="array_sort(concat(transform(_paras, x -> named_struct('v', x.b, 'k', 0)), transform(_s, x -> named_struct('v', x.a, 'k', 1))))",
        _r="transform(filter(transform(_e, (x, t) -> named_struct('k', x.k, 't', t)), x -> x.k = 1), (x, j) -> x.t - j)",
        _met="filter(transform(_s, (x, j) -> named_struct('p', _r[j], 'a', greatest(x.a, get(_paras, _r[j]).a), 'b', least(x.b, get(_paras, _r[j]).b), 'i', x.i)), x -> x.p < size(_paras) and x.a < x.b)",
        _gaps="transform(_met, (x, j) -> named_struct('p', x.p, 'a', case when j > 0 and _met[j - 1].p = x.p then _met[j - 1].b else _paras[x.p].a end, 'b', x.a, 'i', cast(null as int)))",
        _tails="filter(transform(_met, (x, j) -> named_struct('p', x.p, 'a', x.b, 'b', _paras[x.p].b, 'i', cast(null as int), 'last', j = size(_met) - 1 or _met[j + 1].p != x.p)), x -> x.last)",
        _bare="transform(array_except(case when size(_paras) > 0 then sequence(0, size(_paras) - 1) else array() end, transform(_met, x -> x.p)), p -> named_struct('p', p, 'a', _paras[p].a, 'b', _paras[p].b, 'i', cast(null as int)))",
        _t="array_sort(filter(concat(_met, _gaps, transform(_tails, x -> named_struct('p', x.p, 'a', x.a, 'b', x.b, 'i', x.i)), _bare), x -> x.a < x.b))",
        _first="filter(transform(_t, (x, j) -> case when j = 0 or _t[j - 1].p != x.p then j end), j -> j is not null)",
        _pieces=f"regexp_extract_all(_text, '(?s).{{1,{PIECE}}}', 0)",
    )
    near = f"array_join(slice(_pieces, cast(t.a div {PIECE} as int) + 1, cast((t.b - 1) div {PIECE} - t.a div {PIECE} as int) + 1), '')"
    cut = f"substring({near}, cast(t.a % {PIECE} as int) + 1, cast(t.b - t.a as int))"
    each = rows.select("doc_id", F.explode(F.expr(f"transform(_t, (t, j) -> named_struct('p', t.p, 'k', j - _first[t.p], 'i', t.i, 'text', {cut}))")).alias("x"))
    tokens = each.select(
        "doc_id", F.col("x.p").alias("para_idx"), F.col("x.k").alias("token_idx"), F.col("x.i").isNotNull().alias("is_sentence"),
        F.when(F.col("x.i").isNotNull(), anchor_id(F.col("x.i"))).alias("anchor_id"), "x.text",
    )
    if sources is None:
        return tokens.withColumn("source_class", F.lit(""))
    cls = F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_CLASS.items() for x in kv)), F.col("source"))
    met = tokens.join(sources.select("doc_id", "anchor_id", "source"), ["doc_id", "anchor_id"], "left")
    return met.select(*tokens.columns, F.coalesce(cls, F.lit("")).alias("source_class"))


def ordered_cards(cards: DataFrame, sentences: DataFrame, side: str) -> DataFrame:
    """One side's matched cards with ``place``, their order in the document."""
    at = sentences.select("doc_id", "anchor_id", F.col("sentence_idx").alias("_at"))
    rows = cards.drop("sentence_idx").where((F.col("side") == side) & F.col("anchor_id").isNotNull()).join(at, ["doc_id", "anchor_id"], "left")
    return rows.withColumn("place", F.coalesce("_at", F.lit(FAR))).drop("_at")


def annotation_rows(cards: DataFrame, sentences: DataFrame) -> DataFrame:
    """Every card of either side as a row of the all-annotations view, with ``place`` for sorting by (place, source, coder)."""
    at = sentences.select("doc_id", "anchor_id", F.col("sentence_idx").alias("_at"), F.col("text").alias("_text"))
    rows = cards.drop("sentence_idx").join(at, ["doc_id", "anchor_id"], "left")
    ai = F.col("side") == "ai"
    sub = F.when(F.coalesce("subcategory", F.lit("")).isin("", "-"), F.col("category")).otherwise(F.col("subcategory"))
    return rows.select(
        "doc_id", F.when(ai, "AI").otherwise("Human").alias("source"), F.when(ai, "AI").otherwise(coder_name(F.col("coder"), F.col("coder_name"))).alias("coder"),
        F.coalesce("anchor_id", F.lit("(unmatched)")).alias("anchor_id"), F.substring(F.coalesce("_text", "sentence_excerpt"), 1, 120).alias("sentence"),
        F.col("kind").alias("type"), "category", sub.alias("subcategory"), F.when(F.col("kind") == "Risk Mitigation", F.col("strength")).alias("strength"),
        F.coalesce("_at", F.lit(FAR)).alias("place"),
    )


def select_rows(rows: DataFrame, page: int = 0, size: int | None = 50, **chosen: list) -> DataFrame:
    """Rows whose columns are among the chosen values (an empty choice is all), in order, one page of them."""
    for column, values in chosen.items():
        if values:
            rows = rows.where(F.col(column).isin(list(values)))
    rows = rows.orderBy("place", "source", "coder")
    return rows if size is None else rows.offset(page * size).limit(size)


def tag_rows(rows: DataFrame) -> DataFrame:
    """Adds ``tag_row``: 1..n within a sentence."""
    return rows.withColumn("tag_row", F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("final_tag")))
