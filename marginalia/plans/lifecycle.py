"""Whole runs: documents to annotations, aligned cards and counts, as one lazy plan over all documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..operators.align import align, align_counts
from ..operators.annotations import dedupe_annotations, validate_annotations
from ..operators.chunks import chunk_arrays, chunk_rows
from ..operators.sentences import build_index, sentence_arrays
from ..scratch import settled
from .annotators import Annotator, annotations_of, parse_reply
from .prompts import numbered
from .strategies import Strategy
from .workflows import WORKFLOWS, Phases


@dataclass
class Run:
    """The tables of a run."""

    sentences: DataFrame
    chunks: DataFrame
    annotations: DataFrame
    reasons: DataFrame
    cards: DataFrame | None = None
    counts: DataFrame | None = None


def missing(docs: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """Documents without a run of this version."""
    return docs.join(runs.where(F.col("version_id") == version).select("doc_id"), "doc_id", "left_anti")


def coverage(docs: DataFrame, keywords: list[str], window_sentences: int = 20) -> DataFrame:
    """doc_id, n_sentences, n_hits, n_chunks, covered (sentences in a keyword window): what a keyword strategy would see."""
    found = chunk_arrays(sentence_arrays(docs), "keyword_window", keywords, window_sentences=window_sentences)
    covered = F.expr("aggregate(_r, 0L, (t, r) -> t + r.hi - r.lo + 1)")
    long = lambda c, name: F.size(c).cast("long").alias(name)
    return found.select("doc_id", F.col("_n").cast("long").alias("n_sentences"), long("_h", "n_hits"), long("_r", "n_chunks"), covered.alias("covered"))


def run_strategy(docs: DataFrame, strategy: Strategy, annotator: Annotator, taxonomy: DataFrame, keywords: list[str] | None = None,
                 prompt: str = "", human: DataFrame | None = None, rubric: DataFrame | None = None, rules: str = "", folder: str | None = None) -> Run:
    """Index, cut, annotate, de-duplicate, validate, and align if human labels are given.

    The single workflow asks once for each chunk, which is made within its document's row; hits are found only for chunkers that need
    them.  A phased workflow asks phase by phase about numbered sentences (see ``plans.workflows``) and keeps replies under ``folder``.
    """
    sentences, arrays = build_index(docs), sentence_arrays(docs)
    if strategy.workflow == "single":
        wanted = keywords or [] if strategy.chunker.startswith("keyword") else None
        chunks = chunk_rows(arrays, strategy.chunker, wanted, **strategy.chunker_params)
        rows = annotations_of(parse_reply(annotator.annotate(chunks, prompt)))
    else:
        rows = settled(WORKFLOWS[strategy.workflow](arrays, Phases(annotator, taxonomy, rubric, rules, folder, strategy.id)))
        chunks = numbered(sentences).withColumn("chunk_id", chunk_id(F.lit(0)))
    valid, reasons = validate_annotations(dedupe_annotations(rows), taxonomy)
    run = Run(sentences, chunks, valid, reasons)
    if human is not None:
        run.cards = align(sentences, valid, human, taxonomy)
        run.counts = align_counts(run.cards, human)
    return run
