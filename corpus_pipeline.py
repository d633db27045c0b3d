"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its predecessor
kept.  ``run`` writes every result as Parquet to the shared scratch folder and reads it again, so a lost
executor costs a stage's tasks at most.  All stages but the last return the columns of documents.

In every stage a null text counts as the empty text, texts of any length are read whole, further columns of any name come along, and an
empty table gives an empty result; what else is defined stands with each stage, and in full in the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, exact_dedup, mixing, near_copies, quality
from marginalia.llm.shared import release, scratch_scope, stored


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: documents that score below 0.7 go.

    Null and empty texts are one empty passage and have a score like any other; rows that repeat a text share its score, so they stay or
    go together.  Without labelled rows the score is the untrained 0.5, so that every document goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, least=0.7)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text: the one with the largest doc_id.

    A null and an empty text are one text; a null id loses to any other; of rows that repeat the id and the text of the one that stays, one stays.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies: the one with the smallest doc_id.

    Near copies have linked SimHash fingerprints of five-word shingles, or sets of such shingles with a Jaccard similarity of 0.8 or more.
    Texts without words are one group; null ids lose to any other, and rows that share an id stay or go together.
    """
    return near_copies.keep_one_per_group(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: once for each round that takes words of one.

    A null source is a source of its own, the last one; documents without words are never taken; rows that repeat an id have their own
    plans; draws hang on ids, texts and a fixed seed.
    """
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of the ids and of the decoded bytes; an empty text has no ids."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_bytes),
]

#: Trained scores, fingerprints, draws and merges are beyond SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written and read again as the next one's docs.

    What a stage writes beside its result goes when it ends, and its input with it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch_scope(spark) as keep:
            docs = stored(stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-"))
            keep.append(docs)
        release(before)
    return docs
