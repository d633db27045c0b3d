"""Exact duplicates by a heavy-hitter split, with DataFrame and SQL functions only.

1. Each row's SHA-256 digest is computed in one pass over the texts and kept (40 bytes a row).
2. A Misra-Gries summary (Spark's ``approx_top_k`` family keeps a Misra-Gries style frequent-items
   sketch with a fixed number of counters) is built per task and merged in two levels.  It proposes
   at most ``counters`` frequent digests, whatever the input's size.
3. The proposals are verified by an exact, map-side-combined count; those with at least
   ``heavy_rows`` rows are the winners: at most ``counters`` rows, which bounds the broadcast.
4. Rows of winners get their answer on the map side and never enter a shuffle; all other rows are
   shuffled by digest, where no digest can be frequent any more.

Defined results: a null text counts as the empty text; every row comes back, repeated rows too; among
equal texts the largest id stays, and rows that repeat that id with the same text are the same
document, so all are marked kept (``drop_duplicates`` leaves one of them); null ids lose to any
other; an empty table gives an empty result; texts of any length are hashed whole; other columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, pruned, stored, without

COUNTERS = 2048
HEAVY_ROWS = 64
FIRST_LEVEL = 64


def digest_of(text) -> F.Column:
    """SHA-256 of the text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` 64-bit digest prefixes that the Misra-Gries summary holds as frequent.

    ``prefix`` is the only column needed and returned.  Summaries have a fixed size, so the first
    level reads one per task and group and the last one at most ``FIRST_LEVEL``.
    """
    firsts = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(FIRST_LEVEL)).alias("_part")).agg(
        F.expr(f"approx_top_k_accumulate(prefix, {counters})").alias("_sketch")
    )
    # grouped by one value, since a task without rows would hand an empty summary to an ungrouped merge
    merged = firsts.groupBy((F.col("_part") >= FIRST_LEVEL).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(_sketch, {counters})").alias("_sketch")
    )
    found = merged.select(
        F.explode(F.expr(f"approx_top_k_estimate(_sketch, {counters})")).alias("_hit")
    )
    return found.select(F.col("_hit.item").alias("prefix"))


def mark_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = pruned(docs, _id=id_col, _text=text_col).select("_id", digest_of(F.col("_text")).alias("_digest"))
    rows = stored(rows, "digests")
    prefix = F.conv(F.hex(F.substring("_digest", 1, 7)), 16, 10).cast("long")
    rows = rows.withColumn("prefix", prefix)

    proposed = F.broadcast(frequent_digests(rows, counters))
    winners = (
        rows.join(proposed, "prefix")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") >= heavy_rows)
    )
    winners = F.broadcast(stored(winners, "heavy"))
    heavy = rows.join(winners, "_digest").select("_id", "_digest", "_keep", "_size")

    group = Window.partitionBy("_digest")
    light = (
        rows.join(winners, "_digest", "left_anti")
        .withColumn("_keep", F.max("_id").over(group))
        .withColumn("_size", F.count(F.lit(1)).over(group))
        .select("_id", "_digest", "_keep", "_size")
    )
    return heavy.unionAll(light).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns, whatever their names.

    Texts are not shuffled: the rows that go are few and are named by (id, digest), see :func:`without`.  Only rows that repeat
    the id and the text of one that stays pass a shuffle, which leaves one of them.
    """
    marks = stored(mark_duplicates(docs, id_col, text_col, **params).select(F.col(f"`{id_col}`").alias("_id"), F.unhex("text_sha256").alias("_digest"), "kept"), "marks")
    own, gid, gdigest = fresh(docs, "_own_digest", "_gone_id", "_gone_digest")
    named = lambda df: df.select(F.col("_id").alias(gid), F.col("_digest").alias(gdigest))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(gid)) & (F.col(own) == F.col(gdigest))
    gone = stored(named(marks.where("not kept")), "gone")
    repeated = stored(named(marks.where("kept").groupBy("_id", "_digest").count().where("count > 1")), "repeated")
    left = without(docs.withColumn(own, digest_of(F.col(f"`{text_col}`"))), gone, same)
    if not repeated.isEmpty():
        once = without(left, repeated, same, "left_semi").dropDuplicates([id_col, own])
        left = without(left, repeated, same).unionByName(once)
    return left.drop(own)
