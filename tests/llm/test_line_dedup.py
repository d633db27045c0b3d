import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import line_dedup, shared

LOW = str.maketrans(line_dedup.CAPITALS, line_dedup.SMALLS)


def brute(rows, least_chars=40, least_docs=5):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, kept text)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := key(x)) >= least_chars and len(holders[k]) >= least_docs and i != max(holders[k], key=rank) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def cut(docs, **params):
    found, names = line_dedup.cut_lines(docs, **params)
    return sorted(((r.doc_id, r[names["n_lines"]], r[names["n_dropped"]], r[names["text"]]) for r in found.collect()), key=repr)


LONG = "A line that is long enough to be counted, number {}"


def shared_lines(n):
    """Lines that a third of all documents, five, four or one of them hold; with blanks, capitals and repeats."""
    rows = []
    for i in range(n):
        lines = [f"own {i}", LONG.format(f"only {i}")]
        if i % 3 == 0:
            lines += ["  " + LONG.format("hot") + "\t", LONG.format("HOT").upper(), "", LONG.format("hot")]
        if i < 5:
            lines.insert(1, LONG.format("five é"))
            lines.append(LONG.format("FIVE é").upper().replace("É", "é"))
        if 10 <= i < 14:
            lines += [LONG.format("four")] * 3
        if i % 4 == 0:
            lines.append("short and shared")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("small", [1 << 18, -1])
def test_equals_brute_force_by_broadcast_and_by_filter(spark, odd, monkeypatch, small):
    monkeypatch.setattr(shared, "SMALL_SIDE", small)
    rows = shared_lines(120) + [(None, LONG.format("hot")), (None, LONG.format("five é")), (3, LONG.format("hot")), (117, LONG.format("hot")), (119, None), (118, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut(docs) == brute(rows)
    assert cut(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert cut(odd, least_chars=1, least_docs=2) == brute([(r.doc_id, r.text) for r in odd.collect()], 1, 2)


@pytest.mark.parametrize("small", [1 << 18, -1])
def test_a_row_that_is_a_third_of_the_table(spark, monkeypatch, small):
    monkeypatch.setattr(shared, "SMALL_SIDE", small)
    rows = [(7, LONG.format("hot") + "\nx") if i % 3 == 0 else (i, LONG.format("hot" if i % 5 else i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert cut(docs) == brute(rows)


def test_a_hot_line_lies_in_many_ranges(spark, apart):
    lines = spark.range(6000).select(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("pos"))
    gone = line_dedup.dropped_lines(shared.stored(lines, "hot"), 5)
    assert gone.count() == 5999 and gone.agg(F.max("doc")).first()[0] == 5998
    assert gone.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000


def test_runs_decide_alike_however_they_are_cut():
    """Every cut of a sorted table into batches and partitions, against the definition."""
    rng = np.random.default_rng(3)
    rows = sorted((int(h), 0, -int(d), 0, k) for k, (h, d) in enumerate(zip(rng.choice([1, 1, 1, 2, 3, 4, 5], 160), rng.integers(0, 12, 160))))
    table = np.array([(h, g, -d, t, p) for h, g, d, t, p in rows], np.int64).T
    docs = defaultdict(set)
    for h, d in zip(table[0], table[2]):
        docs[int(h)].add(int(d))
    want = sorted(int(p) for h, d, p in zip(table[0], table[2], table[4]) if len(docs[int(h)]) >= 5 and d != max(docs[int(h)]))
    for seed in range(60):
        rng = np.random.default_rng(seed)
        edges = [0, *sorted(rng.integers(0, 161, rng.integers(0, 6)).tolist()), 160]
        told, most = [], 0
        for a, b in zip(edges, edges[1:]):
            runs, step = line_dedup.Runs(5), int(rng.integers(1, 40))
            for i in range(a, b, step):
                runs.add(table[:, i : min(b, i + step)])
                most = max(most, 0 if runs.held is None else len(set(runs.held[2])))
            runs.end()
            told += runs.out
        pieces = defaultdict(set)
        for verdict, r in told:
            if verdict == line_dedup.PIECE:
                for h, d in zip(r[0], r[2]):
                    pieces[int(h)].add(int(d))
        got = [int(p) for v, r in told if v == line_dedup.DROP for p in r[4]]
        got += [int(p) for v, r in told if v == line_dedup.OPEN for h, d, p in zip(r[0], r[2], r[4]) if len(pieces[int(h)]) >= 5 and d != max(pieces[int(h)])]
        assert sorted(got) == want and most < 5


def test_bitmaps_mark_what_stays(spark):
    rows = shared_lines(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maps = {r.doc: r for r in line_dedup.keep_bitmaps(docs).collect()}
    for i, n, dropped, kept in brute(rows):
        if dropped:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[i].keep), np.uint8)).tolist()
            lines = dict(rows)[i].split("\n")
            assert "\n".join(x for x, b in zip(lines, bits + [1] * n) if b) == kept and maps[i].n_dropped == dropped
        else:
            assert i not in maps


def test_documents_come_back_with_their_columns(spark, monkeypatch):
    for small in (1 << 18, -1):
        monkeypatch.setattr(shared, "SMALL_SIDE", small)
        rows = [(i, t, "x", "y", 1, "z", "b") for i, t in shared_lines(40)] + [(99, None, "x", "y", 1, "z", "b")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, keep string, _doc string, _tx int, _row string, _block string")
        found = line_dedup.drop_repeated_lines(docs)
        assert found.columns == docs.columns
        got = {r.doc_id: r for r in found.collect()}
        want = {i: t for i, _, _, t in brute([(r[0], r[1]) for r in rows])}
        assert {i: r.text or "" for i, r in got.items()} == want and got[99].text is None
        assert all((r.keep, r._doc, r._tx, r._row, r._block) == ("x", "y", 1, "z", "b") for r in got.values())


def test_hashes_of_the_query_are_those_of_the_texts(spark, sf):
    from marginalia.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(i, n, d, sha256(t.encode()).hexdigest()) for i, n, d, t in brute([(r.doc_id, r.text) for r in docs])]
    assert sorted(tuple(r) for r in queries.op13_line_dedup(spark, sf).collect()) == sorted(want)


def test_empty_table(empty):
    assert cut(empty) == []
