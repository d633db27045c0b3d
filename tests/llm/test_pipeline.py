from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import exact_dedup, mixing, near_copies, quality
from marginalia.llm.shared import stored


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    calls = {"quality classifier": quality, "exact dedup": exact_dedup, "simhash near-dedup": near_copies, "mixing sources": mixing}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), "test")
        sizes.append(docs.count())
        if name in calls:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "exact dedup":
            assert docs.count() == before.select(F.coalesce("text", F.lit(""))).distinct().count()
        if name == "simhash near-dedup":
            assert docs.count() == near_copies.near_groups(before).select("component_id").distinct().count()
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[5] == sizes[4] > 0
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
