"""Reviewer feedback: de-duplication and few-shot examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("doc_slug", "anchor_id", "kind", "category", "subcategory")
# The decisions that examples are drawn from, and how many of each.
DECISIONS = {"AI-flagged incorrectly": 5, "Human Miss": 2}
LEAST = 60


def dedupe_feedback(rows: DataFrame, key: tuple[str, ...] = KEY, order: str = "seq") -> DataFrame:
    """The first row of each key; null equals null."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def diverse_top(rows: DataFrame, n: int, label: str, length: str, order: str = "seq") -> DataFrame:
    """``n`` rows: the longest of each label first, then others by length; ``rank`` is their place.

    Each label needs its n longest rows at most, so the last step sees few rows, whatever the table's size.
    """
    longest = Window.partitionBy(label).orderBy(F.desc(length), order)
    few = rows.withColumn("_in", F.row_number().over(longest)).where(F.col("_in") <= n)
    first = few.withColumn("_again", (F.col("_in") > 1).cast("int")).orderBy("_again", F.desc(length), order).limit(n)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_again", F.desc(length), order))  # n rows
    return first.withColumn("rank", place).drop("_in", "_again")


def few_shot_examples(rows: DataFrame, decisions: dict[str, int] | None = None, least: int = LEAST) -> DataFrame:
    """Examples by decision, in the order of ``decisions``; explanations shorter than ``least`` are left out."""
    out = None
    for i, (decision, n) in enumerate((decisions or DECISIONS).items()):
        pool = dedupe_feedback(rows.where(F.col("decision") == decision)).withColumn("_len", F.length("explanation_long"))
        part = diverse_top(pool.where(F.col("_len") >= least), n, "explanation", "_len").withColumn("part", F.lit(i)).drop("_len")
        out = part if out is None else out.unionByName(part)
    return out
