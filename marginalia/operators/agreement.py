"""Agreement and adjudication columns of an annotation tool's export.

Tag rows: doc_id, annotation_id, annotator, group_id, ordinals (array of sentence numbers), kind, category, subcategory,
strength.  A tag over several sentences is one row (a span).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_LABEL = "-"
TAG = ("kind", "category", "subcategory")


def tag_text(with_strength: bool = False) -> F.Column:
    """``Kind · Category · Subcategory``, and the strength as S1 to S3."""
    parts = F.concat_ws(" · ", *(F.coalesce(c, F.lit(NO_LABEL)) for c in TAG))
    return F.concat(parts, F.when(F.col("strength").isNotNull(), F.concat(F.lit(" · S"), "strength")).otherwise("")) if with_strength else parts


def per_sentence(tags: DataFrame) -> DataFrame:
    """A row for each tag and sentence it covers."""
    return tags.select("*", F.explode("ordinals").alias("ordinal")).withColumn("tag", tag_text())


def sentence_disputes(tags: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """doc_id, ordinal, n_tagging, disputed, strength_disputed.

    Disputed: not every annotator of the document tagged the sentence, or their tag sets differ.  ``expected``
    (doc_id, n_annotators) counts assigned annotators; by default those with a row.
    """
    rows = per_sentence(tags)
    present = tags.groupBy("doc_id").agg(F.countDistinct("annotator").alias("_present"))
    sets = rows.groupBy("doc_id", "ordinal", "annotator").agg(F.array_join(F.array_sort(F.collect_set("tag")), "\x1f").alias("s"))
    by = sets.groupBy("doc_id", "ordinal").agg(F.count(F.lit(1)).alias("n_tagging"), (F.min("s") != F.max("s")).alias("_differ"))
    strong = rows.where("strength is not null").groupBy("doc_id", "ordinal", "tag").agg((F.min("strength") != F.max("strength")).alias("_sd"))
    strong = strong.groupBy("doc_id", "ordinal").agg(F.bool_or("_sd").alias("strength_disputed"))
    joined = by.join(present, "doc_id")
    n = F.col("_present")
    if expected is not None:
        joined = joined.join(expected.select("doc_id", "n_annotators"), "doc_id", "left")
        n = F.greatest(n, F.coalesce("n_annotators", n))
    joined = joined.withColumn("disputed", F.col("_differ") | (F.col("n_tagging") < n)).join(strong, ["doc_id", "ordinal"], "left")
    return joined.select("doc_id", "ordinal", "n_tagging", "disputed", F.coalesce("strength_disputed", F.lit(False)).alias("strength_disputed"))


def tag_disputes(tags: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """annotation_id with disputed, strength_disputed (any member sentence) and pair_disputed (nobody else gave this tag there)."""
    rows = per_sentence(tags)
    by_sentence = sentence_disputes(tags, expected)
    others = rows.groupBy("doc_id", "ordinal", "tag").agg(F.countDistinct("annotator").alias("_givers"))
    joined = rows.join(by_sentence, ["doc_id", "ordinal"]).join(others, ["doc_id", "ordinal", "tag"])
    return joined.groupBy("doc_id", "annotation_id").agg(
        F.bool_or("disputed").alias("disputed"), F.bool_or("strength_disputed").alias("strength_disputed"),
        (F.max("_givers") < 2).alias("pair_disputed"),
    )


def adjudicated_status(disputed: F.Column, resolved: F.Column, legacy: F.Column | None = None) -> F.Column:
    """Resolved wins over agreed, and that over disputed; legacy filings have none."""
    status = F.when(resolved, "resolved").when(disputed, "disputed").otherwise("agreed")
    return status if legacy is None else F.when(~legacy, status)


def final_parts(final_tags: F.Column) -> dict[str, F.Column]:
    """The first of ``'; '``-joined final tags in its parts; all null where there is none."""
    first = F.split(F.element_at(F.split(final_tags, "; "), 1), " · ")
    has = F.coalesce(final_tags, F.lit("")) != ""
    part = lambda i: F.when(has, F.try_element_at(first, F.lit(i)))
    return {
        "final_kind": part(1), "final_category": part(2), "final_subcategory": part(3),
        "final_strength": F.regexp_extract(F.coalesce(part(4), F.lit("")), "^S([1-3])$", 1).try_cast("int"),
        "n_final_tags": F.when(has, F.size(F.split(final_tags, "; "))).otherwise(0),
    }


def collapse_spans(members: DataFrame) -> DataFrame:
    """One row per group_id (or annotation) of member rows (ordinal, sentence_text, keywords): count, ordinals, text, keyword union."""
    key = F.coalesce(F.col("group_id"), F.concat(F.lit("#"), F.col("annotation_id").cast("string")))
    m = F.array_sort(F.collect_list(F.struct("ordinal", "sentence_text", "keywords", "annotation_id")))
    rows = members.groupBy("doc_id", "annotator", *TAG, key.alias("span")).agg(m.alias("m"))
    words = F.array_sort(F.array_distinct(F.flatten(F.col("m.keywords"))))
    return rows.select(
        "doc_id", "annotator", *TAG, "span", F.array_min("m.annotation_id").alias("annotation_id"), F.size("m").alias("spans_n_sentences"),
        F.array_join("m.ordinal", ",").alias("context_sentence_ordinals"), F.array_join("m.sentence_text", " ").alias("context_sentence_text"),
        F.array_join(words, "; ").alias("matched_keywords"),
    )


def final_labels(tags: DataFrame, resolutions: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row per tagged sentence: both annotators' tags, the final tags and where they come from.

    ``resolutions``: doc_id, ordinal, final_tags (empty: resolved to none), is_span.  final_source is agreed, resolved,
    resolved_to_none, resolved_span, solo or pending.  Annotators A and B are by name within a document.
    """
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("annotator"))
    people = tags.select("doc_id", "annotator").distinct().withColumn("_r", rank)
    rows = per_sentence(tags).withColumn("full", tag_text(True)).join(people, ["doc_id", "annotator"])
    pick = lambda i: F.array_join(F.array_sort(F.collect_set(F.when(F.col("_r") == i, F.col("full")))), "; ")
    who = lambda i: F.max(F.when(F.col("_r") == i, F.col("annotator")))
    wide = rows.groupBy("doc_id", "ordinal").agg(
        pick(1).alias("annotator_a_tags"), pick(2).alias("annotator_b_tags"), who(1).alias("annotator_a"), who(2).alias("annotator_b"),
        F.array_join(F.array_sort(F.collect_set("tag")), "; ").alias("_own"),
    )
    n = people.groupBy("doc_id").agg(F.max("_r").alias("_n"))
    out = wide.join(sentence_disputes(tags, expected), ["doc_id", "ordinal"]).join(n, "doc_id").join(resolutions, ["doc_id", "ordinal"], "left")
    solved = F.col("final_tags").isNotNull()
    source = (
        F.when(solved & (F.col("final_tags") == ""), "resolved_to_none").when(solved & F.coalesce("is_span", F.lit(False)), "resolved_span")
        .when(solved, "resolved").when(~F.col("disputed"), F.when(F.col("_n") == 1, "solo").otherwise("agreed")).otherwise("pending")
    )
    official = F.when(solved, F.col("final_tags")).when(~F.col("disputed"), F.col("_own")).otherwise("")
    return out.select(
        "doc_id", "ordinal", official.alias("final_tags"), source.alias("final_source"), F.when(official == "", 0).otherwise(F.size(F.split(official, "; "))).alias("n_final_tags"),
        "annotator_a", "annotator_a_tags", "annotator_b", "annotator_b_tags", "strength_disputed", "disputed",
        adjudicated_status(F.col("disputed"), solved).alias("adjudicated_status"),
    )


def adjudication_report(labels: DataFrame) -> DataFrame:
    """Sentences that were or are in dispute, with both sides and the decision."""
    return labels.where("disputed or adjudicated_status = 'resolved'").select(
        "doc_id", "ordinal", "annotator_a", "annotator_a_tags", "annotator_b", "annotator_b_tags", "adjudicated_status", "final_tags"
    )


def finalised_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("adjudicated_status").isin("agreed", "resolved"))


def filing_summary(labels: DataFrame) -> DataFrame:
    """Counts per document by state."""
    n = lambda c, name: F.count_if(c).alias(name)
    s, src = F.col("adjudicated_status"), F.col("final_source")
    return labels.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tagged_sentences"), n(s == "agreed", "n_agreed"), n(s == "disputed", "n_disputed_open"), n(s == "resolved", "n_resolved"),
        n(src == "resolved_to_none", "n_resolved_to_none"), F.countDistinct("annotator_a", "annotator_b").alias("n_pairs"),
    )


def filing_people(statuses: DataFrame, comments: DataFrame) -> DataFrame:
    """The lists that a filing's summary holds: annotators, ``Name=status`` and ``Name=time`` (of those that are done), in order of name, how
    many there are, and how many comments there were.

    statuses: doc_id, annotator, status, done_at.  comments: doc_id and one row for each comment.
    """
    by_name = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("annotator", c.alias("v"))))), lambda x: x["v"]), "; ")
    named = lambda c: F.concat("annotator", F.lit("="), F.col(c).cast("string"))
    people = statuses.groupBy("doc_id").agg(
        by_name(F.col("annotator")).alias("annotators"), by_name(named("status")).alias("annotator_statuses"), by_name(named("done_at")).alias("annotator_done_at"),
        F.count(F.lit(1)).alias("n_annotators"),
    )
    return people.join(comments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_comments")), "doc_id", "left").na.fill(0, ["n_comments"])


def parse_comments(comments: F.Column) -> F.Column:
    """``Name (time): text | ...`` as an array of (name, time, text)."""
    rx = r"(?s)^(.*?) \(([^)]*)\): (.*)$"
    part = lambda x, i: F.regexp_extract(x, rx, i)
    items = F.filter(F.split(F.coalesce(comments, F.lit("")), r" \| "), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).alias("time"), part(x, 3).alias("text")))


def coder_names(rows: DataFrame) -> DataFrame:
    """doc_id, coder, coder_name: the most frequent name; at ties the one first seen (by ``seq``)."""
    counts = rows.where("coalesce(coder_name, '') != ''").groupBy("doc_id", "coder", "coder_name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("doc_id", "coder").orderBy(F.desc("n"), "first", "coder_name")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "coder", "coder_name")


def exact_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``copy``: 1 for the first of equal rows, told apart by annotation_id; rows are kept."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("annotation_id")))
