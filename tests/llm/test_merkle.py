from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle, queries, shared

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[1], []).append(r)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    for own in parts.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {n: tree([leaf(r, r[4]) for r in parts[n]]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(parts[n]):
            path = []
            for levels, p in ((trees[n], i), (top, k)):
                for level in levels[:-1]:
                    run = level[p - p % 3 : p - p % 3 + 3]
                    path.append((run[: p % 3], run[p % 3 + 1 :]))
                    p //= 3
            shown = r[4]
            if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and shown is not None:
                shown = shown.replace("\n", "")
            folded = leaf(r, shown)
            for before, after in path:
                folded = h("".join(before) + folded + "".join(after))
            proof = h("".join("".join(b) + "".join(a) for b, a in path))
            out.append((r[0], trees[n][0][i], trees[n][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def proved(docs):
    return sorted((tuple(r) for r in merkle.prove(docs, queries.without_breaks(docs)).select(*COLUMNS).collect()), key=repr)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_proofs_of_odd_rows_equal_brute_force(odd):
    assert proved(odd) == brute(plain(odd))


def test_parts_of_every_size(spark):
    rows = [(k, f"p{n}" if n else None, "en", 3, f"a\n{k}") for n in range(14) for k in range(n * 2 + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert proved(docs) == brute(rows)


@pytest.mark.parametrize("small", [1 << 18, -1])
def test_one_row_for_a_third_of_the_table(spark, monkeypatch, small):
    monkeypatch.setattr(shared, "SMALL_SIDE", small)
    rows = [(7 if i % 3 == 0 else i, "hot" if i % 2 else "s", "en", 1, "t" if i % 3 == 0 else f"t\n{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert proved(docs) == brute(rows)


def test_a_row_that_repeats_lies_in_several_ranges(spark, apart):
    rows = spark.range(4000, numPartitions=4).select(F.lit("g").alias("_g"), F.lit(5).cast("long").alias("_id"), F.lit(b"x").alias("_hash"))
    found = merkle.placed(shared.stored(rows, "equal"), "_g", "_id", "_hash")
    assert sorted(r._pos for r in found.collect()) == list(range(4000))
    assert found.where("_n = 4000").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 2000


def test_a_changed_value_does_not_verify(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert merkle.prove(docs).where("not verified").count() == 0
    other = merkle.prove(docs, F.concat(docs["text"], F.lit("x"))).collect()
    assert other and not any(r.verified for r in other)


def test_proofs_have_a_digest_for_each_sibling(spark):
    rows = [(k, "a", "en", 1, str(k)) for k in range(10)]
    found = merkle.prove(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    for r in found:
        assert len(r.proof) == 32 * sum(s // 3 + s % 3 for s in r.steps) and len(r.steps) == 3


def test_empty_table(empty):
    assert proved(empty) == []
