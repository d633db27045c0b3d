"""What each of five filters removes, in every order of applying them: one pass over the texts, then a CUBE over the failure flags.

1. One pass gives each row its flags, part and text digest (some 70 bytes, kept).  The flag of copies compares ids with the least id of
   the digest, found by a map-side combined minimum; digests of large groups are joined on the map side.
2. Rows are counted by part and flags: at most 32 rows a part, however many documents there are.
3. ``CUBE(part, A, B, C, D, E)`` over these counts.  A grouping set selects some filters; its rows whose selected flags are all false
   hold what survives these filters together.  Subsets without survivors are filled in with zeros.
4. A step of an order goes from one subset of filters to the next larger one: pairs of subsets are joined by (part, subset) and
   subtracted.  Orders, steps and pairs are a fixed table of 600 rows.

Defined results: a null text is empty, with no word; a null part is the empty string, and one with it; a null id is below no id and no
id is below it, so such rows are no copies; rows that repeat an id with its text are the same document, no copies of each other, and each
counts; of repeated labels the larger value holds, and rows without a label count as 0; texts of any length are read whole; an empty table
gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .exact_dedup import digest_of
from .shared import joined_by_key, scratch_scope, stored

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Filters A to D: few words, few distinct words, many capitals, odd signs."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    signs = F.translate(text, "#$%&*|", "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.char_length(text), "D": F.octet_length(signs) < F.octet_length(text),
    }


def failure_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """_id, _part and the flags A to E of every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), part.alias("_part"), text.alias("_text"))
    flags = stored(found.select("_id", "_part", *(c.alias(f) for f, c in text_flags(F.col("_text")).items()), digest_of(F.col("_text")).alias("_digest")), "flags")
    groups = stored(flags.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")), "copies")
    copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    return joined_by_key(flags, groups, "_digest", "_rows").select("_id", "_part", *"ABCD", copy.alias("E"))


def cells(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows, and rows labelled good and toxic, by part and flags.

    Labels are broadcast if they are few; else rows are folded by id before they meet them, so that an id that repeats is no hot key.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("_id"), "quality", "toxic").where("_id is not null and (quality = 1 or toxic = 1)")
    marks = stored(marks.groupBy("_id").agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t")), "labelled")
    if marks.count() <= shared.SMALL_SIDE:
        met = flags.withColumn("_rows", F.lit(1)).join(F.broadcast(marks), "_id", "left")
    else:
        met = flags.groupBy("_id", "_part", *FILTERS).agg(F.count(F.lit(1)).alias("_rows")).join(marks, "_id", "left")
    rows = F.col("_rows").cast("long")
    has = lambda c: F.sum(F.when(F.col(c) == 1, rows).otherwise(F.lit(0).cast("long")))
    return met.groupBy("_part", *FILTERS).agg(F.sum(rows).alias("n"), has("_q").alias("good"), has("_t").alias("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """_part, _mask (a bit for each selected filter) and the counts of rows that none of the selected filters fails, zeros included."""
    grouped = lambda f: F.grouping(f)
    mask = reduce(lambda a, b: a + b, ((1 - grouped(f).cast("int")) * (1 << i) for i, f in enumerate(FILTERS)))
    cube = counted.cube("_part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS), mask.alias("_mask"), grouped("_part").alias("_whole"))
    passed = reduce(lambda a, b: a & b, (~F.coalesce(F.col(f), F.lit(False)) for f in FILTERS))
    found = stored(cube.where((F.col("_whole") == 0) & passed).select("_part", "_mask", *COUNTS), "survivors")
    grid = found.where("_mask = 0").select("_part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("_mask"))
    return grid.join(found, ["_part", "_mask"], "left").na.fill(0, list(COUNTS))


def between(subsets: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (``_mask`` to ``_to``, with columns of their own): what the larger subset loses (``_n``, ``_good``, ``_toxic``) and ``_left``, what it leaves."""
    larger = subsets.select("_part", F.col("_mask").alias("_to"), *(F.col(c).alias(f"_{c}") for c in COUNTS))
    met = subsets.join(F.broadcast(pairs), "_mask").join(larger, ["_part", "_to"])
    return met.select("_part", *(c for c in pairs.columns if c not in ("_mask", "_to")), F.col("_n").alias("_left"), *((F.col(c) - F.col(f"_{c}")).alias(f"_{c}") for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the step's counts: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, bit = docs.sparkSession, {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [("".join(p), k + 1, p[k], sum(bit[f] for f in p[:k]), sum(bit[f] for f in p[: k + 1])) for p in permutations(FILTERS) for k in range(len(p))]
    steps = spark.createDataFrame(steps, "filter_order string, step int, _filter string, _mask int, _to int")
    alone = spark.createDataFrame([(f, 0, b) for f, b in bit.items()], "_filter string, _mask int, _to int")
    last = spark.createDataFrame([(f, ALL - b, ALL) for f, b in bit.items()], "_filter string, _mask int, _to int")
    with scratch_scope(spark) as keep:
        flags = failure_flags(docs, id_col, text_col, part_col)
        subsets = stored(survivors(stored(cells(flags, labels, id_col), "cells")), "subsets")
        walked = stored(between(subsets, steps), "steps")
        own = ["_part", "_filter"]
        totals = between(subsets, alone).select(*own, F.col("_n").alias("_fails")).join(between(subsets, last).select(*own, F.col("_n").alias("_only")), own)
        totals = stored(totals.join(walked.groupBy(*own).agg(F.sum("_n").alias("_all")), own), "totals")
        keep += [walked, totals]
        small = totals.count() <= shared.SMALL_SIDE
    rows = walked.join(F.broadcast(totals) if small else totals, own)
    return rows.select(
        F.col("_part").alias("part"), "filter_order", "step", F.col("_left").alias("kept"), F.col("_n").alias("removed"), (F.col("_fails") - F.col("_n")).alias("redundant"),
        F.col("_only").alias("unique_fails"), F.col("_good").alias("good_lost"), F.col("_toxic").alias("toxic_lost"), F.col("_all").alias("shapley"),
    )
