from collections import defaultdict
from hashlib import sha256

import pytest

from marginalia.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        (repr(i), keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha256((t or "").encode()).hexdigest()) for i, t in rows
    )


def marks(df, **params):
    return sorted((repr(r[0]), *r[1:]) for r in exact_dedup.mark_duplicates(df, **params).collect())


@pytest.mark.parametrize("heavy_rows", [1, 2, 64])
def test_marks_equal_brute_force_whatever_is_heavy(odd, heavy_rows):
    assert marks(odd, heavy_rows=heavy_rows) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_a_group_with_a_third_of_the_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert marks(df, counters=64) == brute(rows)


def test_the_summary_finds_the_hot_digest(spark):
    df = spark.createDataFrame([(7 if i % 3 == 0 else i,) for i in range(9000)], "prefix long").repartition(5)
    assert 7 in {r.prefix for r in exact_dedup.frequent_digests(df, 64).collect()}


def test_dropping_leaves_one_row_for_each_text_with_all_columns(odd):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd.collect()})


def test_empty_table(empty):
    assert exact_dedup.mark_duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0
