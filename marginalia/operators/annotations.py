"""Annotations: de-duplication and validation against a taxonomy.

A run de-duplicates first and validates second, in this order: a risk's strength is cleared only by validation,
so rows that differ in it alone both remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key

RISK, MITIGATION = "Risk", "Risk Mitigation"
LABELS = ("kind", "category", "subcategory")


def dedupe_annotations(rows: DataFrame, by: tuple[str, ...] = ("doc_id",), order: str = "seq") -> DataFrame:
    """The first row of each (sentence key, kind, category, subcategory, strength); null equals null.

    Rows pass a window on a digest of the key, so long sentences are not shuffled twice.
    """
    key = F.sha2(F.concat_ws("\x1f", match_key(F.col("sentence"))).cast("binary"), 256)
    w = Window.partitionBy(*by, "_key", *LABELS, "strength").orderBy(order)
    return rows.withColumn("_key", key).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_key", "_rank")


def drop_reason(rows: DataFrame, taxonomy: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``reason``: the first check a row fails, or null; a risk's strength is cleared.

    ``taxonomy`` (kind, category, subcategory) is a dimension of a few dozen rows.  A subcategory must exist
    somewhere, or, if ``strict``, under its own kind and category.
    """
    tax = taxonomy.agg(
        F.collect_set(F.when(F.col("kind") == RISK, F.col("category"))).alias("_rc"),
        F.collect_set(F.when(F.col("kind") == MITIGATION, F.col("category"))).alias("_mc"),
        F.collect_set("subcategory").alias("_sub"),
        F.collect_set(F.concat_ws("\x1f", *LABELS)).alias("_own"),
    ).first()
    inside = lambda c, values: F.coalesce(F.col(c).isin(sorted(values)) if values else F.lit(False), F.lit(False))
    sub_ok = inside("subcategory", tax["_sub"])
    if strict:
        sub_ok &= F.concat_ws("\x1f", *LABELS).isin(sorted(tax["_own"]))
    mit = F.col("kind") == MITIGATION
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(RISK, MITIGATION), F.lit(False)), "dropped_bad_kind")
        .when(mit & ~F.coalesce(F.col("strength").between(1, 3), F.lit(False)), "dropped_bad_strength")
        .when(mit & ~inside("category", tax["_mc"]), "dropped_unknown_category")
        .when(~mit & ~inside("category", tax["_rc"]), "dropped_unknown_category")
        .when(~sub_ok, "dropped_unknown_subcategory")
    )
    return rows.withColumn("reason", reason).withColumn("strength", F.when(F.col("kind") != RISK, F.col("strength")))


def validate_annotations(rows: DataFrame, taxonomy: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and counts by reason ('kept' for those)."""
    judged = drop_reason(rows, taxonomy, strict)
    counts = judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return judged.where("reason is null").drop("reason"), counts
