"""Keyword hits in sentences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_of(keywords: list[str], word_boundary: bool = False) -> str:
    """One alternation, the longest term first, any case; terms match within words unless told otherwise."""
    terms = sorted({k.strip() for k in keywords if k.strip()}, key=lambda k: (-len(k), k))
    inner = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms)
    return rf"(?iu)\b({inner})\b" if word_boundary else f"(?iu)({inner})"


#: More terms than this are looked up by an automaton, whose cost for a text does not grow with the vocabulary.
LARGE = 500


def automaton_terms(text: Column, keywords: list[str], word_boundary: bool = False) -> Column:
    """What :func:`matched_terms` returns, by an Aho-Corasick automaton that each task builds once from the broadcast terms.

    Of the terms that begin at one place the longest holds, then the search goes on behind it, as an alternation does.  Case is folded sign by sign.
    """
    from pyspark.sql import SparkSession

    terms = SparkSession.active().sparkContext.broadcast(sorted({k.strip() for k in keywords if k.strip()}))

    def fold(t):
        low = t.lower()
        return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in terms.value:
            machine.add_word(fold(term), len(term))
        machine.make_automaton()
        in_word = lambda t, i: 0 <= i < len(t) and (t[i].isalnum() or t[i] == "_")
        ends = lambda t, i: in_word(t, i - 1) != in_word(t, i)

        def one(t):
            longest = {}
            for last, n in machine.iter(fold(t or "")):
                first = last - n + 1
                if n > longest.get(first, 0) and (not word_boundary or ends(t, first) and ends(t, last + 1)):
                    longest[first] = n
            found, free = {}, 0
            for first in sorted(longest):
                if first >= free:
                    free = first + longest[first]
                    found[t[first:free]] = None
            return list(found)

        for batch in batches:
            yield batch.map(one)

    return F.pandas_udf(search, "array<string>")(text)


def matched_terms(text: Column, keywords: list[str], word_boundary: bool = False) -> Column:
    """The distinct surface forms in order of their first match; empty without keywords."""
    if not any(k.strip() for k in keywords):
        return F.array().cast("array<string>")
    if len(keywords) > LARGE:
        return automaton_terms(text, keywords, word_boundary)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern_of(keywords, word_boundary)), F.lit(1)))


def find_hits(sentences: DataFrame, keywords: list[str], word_boundary: bool = False) -> DataFrame:
    """doc_id, sentence_idx, anchor_id, matched_terms of sentences with a match."""
    hits = sentences.select("doc_id", "sentence_idx", "anchor_id", matched_terms(F.col("text"), keywords, word_boundary).alias("matched_terms"))
    return hits.where(F.size("matched_terms") > 0)


def vocabulary_key(keywords: list[str], word_boundary: bool = False) -> str:
    """What cached hits are kept under: another vocabulary is another table."""
    return hashlib.sha256(pattern_of(keywords or [""], word_boundary).encode()).hexdigest()[:16]


def cached_hits(sentences: DataFrame, keywords: list[str], folder: str, word_boundary: bool = False, refresh: bool = False) -> DataFrame:
    """Hits from the folder's table for this vocabulary; computed and written where it is missing."""
    spark, path = sentences.sparkSession, f"{folder}/hits-{vocabulary_key(keywords, word_boundary)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        find_hits(sentences, keywords, word_boundary).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
