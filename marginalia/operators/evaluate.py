"""Evaluation of one side's labels against the other's.

The label frame has a row per anchor with set-valued columns as sorted arrays.  Per-label counts come from exploding the
sets that rows really have, never from crossing rows with the whole taxonomy: a label that a row lacks on both
sides is a true negative and needs no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sorted_join
from .align import small_side

MITIGATION = "Risk Mitigation"
NONE = "none"
FILTERS = ("union", "intersection", "coder_a", "coder_b")


def filter_coders(cards: DataFrame, mode: str = "union") -> DataFrame:
    """Cards of both sides with the human ones reduced by mode.

    intersection: cards whose category both coders gave at the anchor; unmatched human cards go, as nothing
    says that both saw the sentence.
    """
    if mode not in FILTERS:
        raise ValueError(f"unknown coder filter: {mode}")
    ai, human = cards.where("side = 'ai'"), cards.where("side = 'human'")
    if mode == "union":
        return cards
    if mode in ("coder_a", "coder_b"):
        return ai.unionByName(human.where(F.col("coder") == mode[-1].upper()))
    by = human.where("anchor_id is not null").groupBy("doc_id", "anchor_id", F.coalesce("category", F.lit("")).alias("_c"))
    both = by.agg(F.bool_or(F.col("coder") == "A").alias("a"), F.bool_or(F.col("coder") == "B").alias("b")).where("a and b")
    kept = human.withColumn("_c", F.coalesce("category", F.lit(""))).join(both.drop("a", "b"), ["doc_id", "anchor_id", "_c"], "left_semi")
    return ai.unionByName(kept.drop("_c"))


def label_frame(cards: DataFrame, sentences: DataFrame | None = None, mode: str = "union") -> DataFrame:
    """One row per anchor, and one per unmatched card; an anchor that the filter empties keeps its row."""
    some = lambda side, c: F.array_sort(
        F.collect_set(F.when((F.col("side") == side) & (F.coalesce(c, F.lit("")) != ""), F.col(c)))
    )
    top = lambda side: F.max(F.when(F.col("side") == side, F.col("strength")))
    sets = [
        some(side, c).alias(f"{side}_{name}")
        for side in ("ai", "human")
        for c, name in (("category", "categories"), ("kind", "kinds"), ("subcategory", "subcats"))
    ]
    anchors = cards.where("anchor_id is not null").select("doc_id", "anchor_id").distinct()
    chosen = filter_coders(cards, mode)
    wide = chosen.where("anchor_id is not null").groupBy("doc_id", "anchor_id").agg(
        *sets, top("ai").alias("ai_strength_max"), top("human").alias("human_strength_max")
    )
    frame = anchors.join(wide, ["doc_id", "anchor_id"], "left")
    for side in ("ai", "human"):
        for name in ("categories", "kinds", "subcats"):
            frame = frame.withColumn(f"{side}_{name}", F.coalesce(f"{side}_{name}", F.array().cast("array<string>")))
    text = F.lit(None).cast("string")
    if sentences is not None:
        frame = frame.join(sentences.select("doc_id", "anchor_id", F.col("text").alias("sentence_text")), ["doc_id", "anchor_id"], "left")
    else:
        frame = frame.withColumn("sentence_text", text)
    loose = chosen.where("anchor_id is null" + (" and side = 'ai'" if mode == "intersection" else ""))
    order = Window.partitionBy("doc_id", "side").orderBy("sentence_excerpt", "kind", "category", "subcategory", "strength", "coder")
    own = lambda side, c: F.when(
        (F.col("side") == side) & (F.coalesce(c, F.lit("")) != ""), F.array(c)
    ).otherwise(F.array().cast("array<string>"))
    rows = loose.select(
        "doc_id", F.concat(F.lit("unmatched_"), "side", F.lit("_"), F.row_number().over(order) - 1).alias("anchor_id"),
        *(own(s, c).alias(f"{s}_{n}") for s in ("ai", "human") for c, n in (("category", "categories"), ("kind", "kinds"), ("subcategory", "subcats"))),
        *(F.when(F.col("side") == s, F.col("strength")).alias(f"{s}_strength_max") for s in ("ai", "human")),
        F.col("sentence_excerpt").alias("sentence_text"),
    )
    return frame.unionByName(rows)


def indicators(frame: DataFrame) -> DataFrame:
    """doc_id, anchor_id, category, t, p: labels that either side gave, as 0/1."""
    each = frame.select("doc_id", "anchor_id", "human_categories", "ai_categories", F.explode(F.array_union("human_categories", "ai_categories")).alias("category"))
    bit = lambda c: F.expr(f"array_contains({c}, category)").cast("int")
    return each.select("doc_id", "anchor_id", "category", bit("human_categories").alias("t"), bit("ai_categories").alias("p"))


def per_category(frame: DataFrame, categories: DataFrame) -> DataFrame:
    """category, support, predicted, tp, precision, recall, f1 for every label of the taxonomy; 0 where undefined."""
    counts = indicators(frame).groupBy("category").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(F.col("t") * F.col("p")).alias("tp")
    )
    rows = categories.select("category").distinct().join(counts, "category", "left").na.fill(0)
    return rows.select(
        "category", "support", "predicted", "tp",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def displayed(report: DataFrame) -> DataFrame:
    """Two decimals, a dash where a figure is undefined, most support first."""
    two = lambda c, ok: F.when(ok, F.format_string("%.2f", c)).otherwise("—").alias(c)
    s, p = F.col("support") > 0, F.col("predicted") > 0
    return report.select("category", "support", two("precision", p), two("recall", s), two("f1", s & p)).orderBy(F.desc("support"), "category")


def averages(report: DataFrame) -> DataFrame:
    """average (micro, macro, weighted), precision, recall, f1."""
    s = F.sum("support")
    weigh = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), s)
    row = report.agg(
        F.struct(_ratio(F.sum("tp"), F.sum("predicted")).alias("precision"), _ratio(F.sum("tp"), s).alias("recall"),
                 _ratio(2 * F.sum("tp"), s + F.sum("predicted")).alias("f1")).alias("micro"),
        F.struct(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1"))).alias("macro"),
        F.struct(*(weigh(c).alias(c) for c in ("precision", "recall", "f1"))).alias("weighted"),
    )
    long = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("average"), F.col(a).alias("m")) for a in ("micro", "macro", "weighted")))).alias("r"))
    return long.select("r.average", "r.m.precision", "r.m.recall", "r.m.f1")


def coder_agreement(cards: DataFrame, categories: DataFrame) -> DataFrame:
    """Cohen's kappa of coders A and B over anchors x categories, with n_anchors, n_pairs, agreement_anchors.

    Only cells that a coder set are built; the rest of the table follows from its size.  Null kappa where expected agreement is 1.
    """
    human = cards.where("side = 'human' and anchor_id is not null and coder in ('A', 'B') and coalesce(category, '') != ''")
    cells = human.groupBy("doc_id", "anchor_id", "category").agg(
        F.bool_or(F.col("coder") == "A").alias("a"), F.bool_or(F.col("coder") == "B").alias("b")
    )
    known = small_side(categories.select("category").distinct().withColumn("known", F.lit(True)))
    cells = cells.join(known, "category", "left")
    in_tax = F.coalesce("known", F.lit(False))
    by_anchor = cells.groupBy("doc_id", "anchor_id").agg(
        F.bool_and(F.col("a") & F.col("b")).alias("same"),
        F.count_if(in_tax & F.col("a") & F.col("b")).alias("n11"),
        F.count_if(in_tax & F.col("a") & ~F.col("b")).alias("n10"),
        F.count_if(in_tax & ~F.col("a") & F.col("b")).alias("n01"),
    )
    total = by_anchor.agg(
        F.count(F.lit(1)).alias("n_anchors"), F.count_if("same").alias("agreement_anchors"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n11", "n10", "n01"))
    )
    size = categories.select("category").distinct().count()
    rows = total.withColumn("n_pairs", F.col("n_anchors") * size).withColumn("n00", F.col("n_pairs") - F.col("n11") - F.col("n10") - F.col("n01"))
    n = F.col("n_pairs").cast("double")
    a1, b1 = F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01")
    po = (F.col("n11") + F.col("n00")) / n
    pe = (a1 * b1 + (n - a1) * (n - b1)) / (n * n)
    return rows.select(F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"), "n_anchors", "n_pairs", "agreement_anchors")


def strength_confusion(frame: DataFrame) -> DataFrame:
    """human, ai, n over none/1/2/3 for rows where either side has a mitigation; other strengths count as none."""
    bucket = lambda c: F.when(F.col(c).between(1, 3), F.col(c).cast("string")).otherwise(NONE)
    rows = frame.where(F.array_contains("human_kinds", MITIGATION) | F.array_contains("ai_kinds", MITIGATION))
    counts = rows.groupBy(bucket("human_strength_max").alias("human"), bucket("ai_strength_max").alias("ai")).agg(F.count(F.lit(1)).alias("n"))
    return _dense(counts, [NONE, "1", "2", "3"])


def _dense(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Counts on the whole grid of a few labels."""
    grid = counts.sparkSession.createDataFrame([(i, j, h, a) for i, h in enumerate(labels) for j, a in enumerate(labels)], "row int, col int, human string, ai string")
    return grid.join(counts, ["human", "ai"], "left").na.fill(0, ["n"]).select("row", "col", "human", "ai", "n")


def category_confusion(frame: DataFrame, categories: list[str]) -> DataFrame:
    """row, col, human, ai, n over none and the categories (a short list, in its own order)."""
    side = lambda c: F.when(F.size(c) == 0, F.array(F.lit(NONE))).otherwise(F.col(c))
    pairs = frame.where("size(human_categories) + size(ai_categories) > 0")
    pairs = pairs.select(F.explode(side("human_categories")).alias("human"), "ai_categories").select("human", F.explode(side("ai_categories")).alias("ai"))
    return _dense(pairs.groupBy("human", "ai").agg(F.count(F.lit(1)).alias("n")), [NONE, *categories])


def confusion_headlines(matrix: DataFrame) -> DataFrame:
    """headline, human, ai, n: the largest cell of over-tagging, missed, best agreement and confusion; the first in row order at ties."""
    part = (
        F.when((F.col("human") == NONE) & (F.col("ai") != NONE), "over_tagging").when((F.col("ai") == NONE) & (F.col("human") != NONE), "missed")
        .when((F.col("human") == F.col("ai")) & (F.col("ai") != NONE), "best_agreement").when(F.col("ai") != NONE, "confusion")
    )
    first = F.row_number().over(Window.partitionBy("headline").orderBy(F.desc("n"), "row", "col"))
    ranked = matrix.withColumn("headline", part).where("headline is not null and n > 0").withColumn("_r", first)
    return ranked.where("_r = 1").select("headline", "human", "ai", "n")


def strength_headline(matrix: DataFrame) -> DataFrame:
    """The largest off-diagonal cell of a strength matrix; no row if there is none."""
    first = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "row", "col")  # sixteen rows
    return matrix.where("row != col and n > 0").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("human", "ai", "n")


def false_positives(frame: DataFrame) -> DataFrame:
    """category, fp_count over rows that no human labelled."""
    rows = frame.where("size(human_categories) = 0").select(F.explode("ai_categories").alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("fp_count"))


def agreement_class() -> Column:
    """none, ai_only, human_only, exact, partial or disjoint."""
    a, h = F.col("ai_categories"), F.col("human_categories")
    return (
        F.when((F.size(a) == 0) & (F.size(h) == 0), "none").when(F.size(h) == 0, "ai_only").when(F.size(a) == 0, "human_only")
        .when(F.array_sort(a) == F.array_sort(h), "exact").when(F.arrays_overlap(a, h), "partial").otherwise("disjoint")
    )


def comparison_table(frame: DataFrame) -> DataFrame:
    """One row per anchor with joined label sets and the agreement class."""
    text = lambda c, name: F.expr(sorted_join(c)).alias(name)
    return frame.select(
        "doc_id", "anchor_id", F.col("sentence_text").alias("sentence"), text("ai_categories", "ai_categories"), text("human_categories", "human_categories"),
        text("ai_subcats", "ai_subcategories"), text("human_subcats", "human_subcategories"),
        F.col("ai_strength_max").alias("ai_strength"), F.col("human_strength_max").alias("human_strength"), agreement_class().alias("agreement"),
    )


def strength_levels(frame: DataFrame) -> DataFrame:
    """side, levels: the distinct top strengths on rows with a mitigation."""
    rows = frame.where(F.array_contains("human_kinds", MITIGATION) | F.array_contains("ai_kinds", MITIGATION))
    return rows.agg(F.array_sort(F.collect_set("ai_strength_max")).alias("ai"), F.array_sort(F.collect_set("human_strength_max")).alias("human"))
