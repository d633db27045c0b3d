"""Multi-phase labelling: verdict tables of phases joined into annotations.

Verdicts: doc_id, phase, seq, anchor_id and the phase's own columns.  Each phase keeps what the one before kept by
semi-joins on (doc_id, anchor_id); the chain is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import passage_members

RISK, MITIGATION = "Risk", "Risk Mitigation"
ID = ["doc_id", "anchor_id"]


def known(verdicts: DataFrame, sentences: DataFrame) -> DataFrame:
    """Verdicts on anchors that the document has."""
    return verdicts.join(sentences.select(*ID), ID, "left_semi")


def attach_strength(cards: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Strength by anchor alone; of repeated verdicts the last holds; missing is null."""
    last = verdicts.groupBy(*ID).agg(F.max_by("strength", "seq").alias("strength"))
    return cards.drop("strength").join(last, ID, "left")


def _labelled(sentences: DataFrame, kinds: DataFrame, risk_cats: DataFrame, mit_cats: DataFrame, strengths: DataFrame) -> DataFrame:
    """The last phases: categories for each half, strength for mitigations.

    As a phase is asked about kept anchors of its half, verdicts on others are left out; a half without kept anchors asks nothing.
    Texts come last, as ``sentence``; from sentences without a ``text`` column there is none, and no text is shuffled.
    """
    half = lambda cats, kind: cats.join(kinds.where(F.col("kind") == kind).select(*ID).distinct(), ID, "left_semi").select(
        *ID, "seq", F.lit(kind).alias("kind"), "category", "subcategory"
    )
    risks = half(risk_cats, RISK).withColumn("strength", F.lit(None).cast("int"))
    mits = attach_strength(half(mit_cats, MITIGATION), strengths)
    both = risks.unionByName(mits.select(*risks.columns))
    if "text" not in sentences.columns:
        return both.select("doc_id", "anchor_id", "kind", "category", "subcategory", "strength", "seq")
    both = both.join(sentences.select(*ID, F.col("text").alias("sentence")), ID)
    return both.select("doc_id", "anchor_id", "sentence", "kind", "category", "subcategory", "strength", "seq")


def sequential(sentences: DataFrame, candidates: DataFrame, kinds: DataFrame, risk_cats: DataFrame, mit_cats: DataFrame, strengths: DataFrame) -> DataFrame:
    """Four phases: candidates, kind, category, strength."""
    kept = known(candidates, sentences).select(*ID).distinct()
    kinds = kinds.join(kept, ID, "left_semi").where(F.col("kind").isin(RISK, MITIGATION))
    return _labelled(sentences, kinds, risk_cats, mit_cats, strengths)


def passage_candidates(sentences: DataFrame, passages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Sentences within passages, and direct mentions outside of them, in document order by sentence_idx."""
    inside = passage_members(passages, sentences)
    outside = known(mentions, sentences).select(*ID).distinct().join(inside, ID, "left_anti")
    outside = outside.join(sentences.select(*ID, "sentence_idx"), ID).withColumn("topic_summary", F.lit(None).cast("string"))
    cols = ["doc_id", "anchor_id", "sentence_idx", "topic_summary"]
    return inside.select(*cols).unionByName(outside.select(*cols))


def passage_aware(sentences: DataFrame, passages: DataFrame, mentions: DataFrame, context: DataFrame, kinds: DataFrame,
                  risk_cats: DataFrame, mit_cats: DataFrame, strengths: DataFrame) -> DataFrame:
    """Six phases: passages, sweep, context filter, kind, category, strength."""
    candidates = passage_candidates(sentences, passages, mentions)
    kept = context.where("keep").join(candidates, ID, "left_semi").select(*ID).distinct()
    kinds = kinds.join(kept, ID, "left_semi").where(F.col("kind").isin(RISK, MITIGATION))
    return _labelled(sentences, kinds, risk_cats, mit_cats, strengths)
