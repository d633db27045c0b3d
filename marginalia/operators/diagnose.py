"""Where a human-tagged sentence that the machine missed was lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import passage_members

ID = ["doc_id", "anchor_id"]
KINDS = ("Risk", "Risk Mitigation")
# The diagnoses' texts; what stands before the colon is the bucket.
OUTSIDE = ("P1+P2: Not surfaced as a candidate — the sentence was not inside any AI-topic passage Phase 1 identified, "
           "and Phase 2 didn't flag it as a direct AI mention.")
NO_CONTEXT = "Pre-P3: Candidate was in the set but Phase 3 didn't issue a verdict on it."
DROPPED = 'P3 (context filter): DROPPED — reason given: "'
NO_KIND = "Pre-P4: Phase 3 kept it but Phase 4 didn't issue a kind verdict."
NULL_KIND = "P4 (kind decision): kind set to null — Phase 4 decided it wasn't a Risk or Mitigation."
NO_CATEGORY = "P5 (category assignment): Made it through filtering but Phase 5 didn't return a (category, subcategory) tuple."
OTHER = "Tagged by AI but at a different (kind, category, subcategory) than the human — see Document View for the actual AI tags."
SHORT_OUTSIDE = "P1 (candidates): The candidate-identification pass didn't list this sentence as AI-related."
SHORT_CATEGORY = "P3 (category assignment): No category was returned for this sentence."
SHORT_OTHER = "Tagged by AI but at a different (kind, category, subcategory) than the human."
UNMATCHED = "Unmatched human (extraction-side, can't be caught)"


def missed_anchors(cards: DataFrame) -> DataFrame:
    """Anchors with human cards and no machine card."""
    some = cards.where("anchor_id is not null")
    return some.where("side = 'human'").select(*ID).distinct().join(some.where("side = 'ai'").select(*ID).distinct(), ID, "left_anti")


def _folded(**tables: DataFrame) -> DataFrame:
    """Verdicts of all phases by (doc_id, anchor_id) in one aggregation: for each table its last row (by ``seq``, if it has one) as a struct, null without any."""
    own = {name: [c for c in df.columns if c not in (*ID, "seq")] for name, df in tables.items()}
    kinds = {name: ", ".join(f"{c}: {dict(df.dtypes)[c]}" for c in own[name]) for name, df in tables.items()}
    out = None
    for name, df in tables.items():
        said = F.struct(*own[name], F.lit(True).alias("seen"))
        cells = [said.alias(n) if n == name else F.lit(None).cast(f"struct<{kinds[n]}{', ' * bool(kinds[n])}seen: boolean>").alias(n) for n in tables]
        part = df.select(*ID, (F.col("seq") if "seq" in df.columns else F.lit(0)).cast("long").alias("seq"), *cells)
        out = part if out is None else out.unionByName(part)
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in tables]
    return out.groupBy(*ID).agg(*last)


def diagnose_passages(missed: DataFrame, sentences: DataFrame, passages: DataFrame, mentions: DataFrame, context: DataFrame,
                      kinds: DataFrame, risk_cats: DataFrame, mit_cats: DataFrame) -> DataFrame:
    """Adds ``diagnosis`` for the six-phase run; where passages overlap the last one's summary counts, as in the run."""
    members = passage_members(passages, sentences).select(*ID, "topic_summary")
    judged = context.select(*ID, "seq", F.coalesce("keep", F.lit(False)).alias("keep"), "reason")
    listed = risk_cats.select(*ID).unionAll(mit_cats.select(*ID))
    rows = missed.join(_folded(_p=members, _mention=mentions.select(*ID), _v=judged, _k=kinds.select(*ID, "seq", "kind"), _cat=listed), ID, "left")
    kind = F.col("_k.kind")
    reason = F.concat(F.lit(DROPPED), F.btrim(F.coalesce("_v.reason", F.lit(""))), F.lit('"'))
    said = (
        F.when((F.coalesce("_p.topic_summary", F.lit("")) == "") & F.col("_mention").isNull(), OUTSIDE).when(F.col("_v").isNull(), NO_CONTEXT)
        .when(~F.col("_v.keep"), reason).when(kind.isNull(), NO_KIND).when(~kind.isin(*KINDS), NULL_KIND)
        .when(F.col("_cat").isNull(), NO_CATEGORY).otherwise(OTHER)
    )
    return rows.select(*missed.columns, said.alias("diagnosis"))


def diagnose_phases(missed: DataFrame, candidates: DataFrame, kinds: DataFrame, risk_cats: DataFrame, mit_cats: DataFrame) -> DataFrame:
    """Adds ``diagnosis`` for the four-phase run."""
    listed = risk_cats.select(*ID).unionAll(mit_cats.select(*ID))
    rows = missed.join(_folded(_cand=candidates.select(*ID), _k=kinds.select(*ID, "seq", "kind"), _cat=listed), ID, "left")
    kind = F.col("_k.kind")
    named = F.when(kind.isNull(), "None").otherwise(F.concat(F.lit("'"), kind, F.lit("'")))
    filtered = F.concat(F.lit("P2 (kind decision): Filtered as null/non-RAI (returned kind="), named, F.lit(")."))
    said = (
        F.when(F.col("_cand").isNull(), SHORT_OUTSIDE).when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), filtered)
        .when(F.col("_cat").isNull(), SHORT_CATEGORY).otherwise(SHORT_OTHER)
    )
    return rows.select(*missed.columns, said.alias("diagnosis"))


def loss_buckets(diagnosed: DataFrame, cards: DataFrame) -> DataFrame:
    """bucket, n by what stands before the colon, and the unmatched human cards."""
    lost = diagnosed.groupBy(F.substring_index("diagnosis", ":", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    loose = cards.agg(F.count_if((F.col("side") == "human") & F.col("anchor_id").isNull()).alias("n"))
    return lost.unionByName(loose.select(F.lit(UNMATCHED).alias("bucket"), "n"))
