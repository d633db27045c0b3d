import re
from itertools import permutations

import pytest

from marginalia.llm import filter_audit, shared


def brute(docs, labels):
    """docs: (doc_id, source, text)."""
    quality, toxic = {}, {}
    for i, q, t in labels:
        if i is not None:
            quality[i], toxic[i] = max(q or 0, quality.get(i, 0)), max(t or 0, toxic.get(i, 0))
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, source, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        flags = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text],
        }
        fails.append((source or "", {f for f in flags if flags[f]}, quality.get(i) == 1, toxic.get(i) == 1))
    out = []
    for part in {p for p, *_ in fails}:
        own, removed_by = [x[1:] for x in fails if x[0] == part], {}
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                removed_by[f] = removed_by.get(f, 0) + len(gone)
                all_fails = sum(f in x[0] for x in own)
                only = sum(x[0] == {f} for x in own)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), all_fails - len(gone), only, sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*r[:-1], removed_by[r[-1]]) for r in rows]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [1 << 18, -1])
def test_odd_rows_equal_brute_force(spark, odd, monkeypatch, small):
    monkeypatch.setattr(shared, "SMALL_SIDE", small)
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 16)] + [(1, None, 1), (None, 1, 1), (3, 0, 0), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = rows_of(filter_audit.audit(odd, labels))
    assert got == brute([(r.doc_id, r.source, r.text) for r in odd.collect()], marks)


def test_a_third_of_the_rows_are_one_text(spark):
    rows = [(i % 250, "hot" if i % 3 else None, "SAME $" if i % 3 == 0 else f"word {i % 40} " * (i % 150)) for i in range(600)]
    marks = [(i, i % 2, i % 3 % 2) for i in range(0, 250, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    got = rows_of(filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    assert got == brute(rows, marks)


def test_signs_of_the_definition(spark):
    texts = ["", "A" + "b" * 49, "A" + "b" * 48, "a a b", "a a a b b", "x|y", "x\\y", "é É", " \x0b\x1c ", "a\x0cb", None]
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    got = rows_of(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got == brute(rows, [])


def test_empty_table(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
