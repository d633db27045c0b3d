"""The near-copy stage against brute force over all pairs of sets of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import near_copies, simhash

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def close(a, b, least=0.8):
    return a == b or (len(a | b) > 0 and len(a & b) / len(a | b) >= least)


def true_pairs(rows, least=0.8):
    """Pairs of ids whose sets reach the similarity, by an index from shingle to texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    index, found = {}, set()
    for at, (i, s) in enumerate(sets):
        for other in {o for x in s for o in index.get(x, ())}:
            if close(s, sets[other][1], least):
                found.add((sets[other][0], i))
        for x in s:
            index.setdefault(x, []).append(at)
    empty = [i for i, s in sets if not s]
    return found | {(empty[0], i) for i in empty[1:]}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def planted(seed=5):
    """Clean texts, near copies on both sides of 0.8, chains, and a family that holds a third of all rows."""
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        base = rng.choices(WORDS, k=rng.randrange(30, 400))
        texts += [base, changed(rng, base, max(1, len(base) // 60)), changed(rng, base, len(base) // 12)]
    step = rng.choices(WORDS, k=200)
    for _ in range(12):
        step = changed(rng, step, 2)
        texts.append(step)
    family = rng.choices(WORDS, k=120)
    texts += [changed(rng, family, rng.randrange(1, 3)) for _ in range(400)]
    texts += [rng.choices(WORDS, k=rng.randrange(0, 60)) for _ in range(300)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def labels_of(found):
    return {r.doc_id: r.component_id for r in found.collect()}


def test_groups_equal_brute_force(spark):
    rows = planted()
    got = labels_of(near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    pairs = true_pairs(rows)
    assert len(pairs) > 5000 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    # nothing else is linked: what fingerprints and similar sets connect, by brute force, is at least what was found
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    for at, fp in enumerate(fps):
        for other in np.nonzero([(fp ^ f).bit_count() <= 2 for f in fps[:at]])[0]:
            pairs.add((rows[other][0], rows[at][0]))
    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(i) == top(c) for i, c in got.items())
    assert all(c <= i for i, c in got.items())


def test_parts_of_a_crowded_key_are_joined(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP", 8)
    rng = random.Random(3)
    family = rng.choices(WORDS, k=150)
    rows = [(i, " ".join(changed(rng, family, 1))) for i in range(300)]
    got = labels_of(near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert set(got.values()) == {0}


def test_no_pair_of_a_crowded_key_is_lost(spark, monkeypatch):
    """One key for all texts, and no fingerprints: near copies are linked whatever parts of the key they are dealt into, slice by slice."""
    whole = near_copies.shapes
    one = lambda *a: whole(*a).withColumn("bands", F.array(F.lit(7).cast("long"))).withColumn("_fp", F.xxhash64("node"))
    monkeypatch.setattr(near_copies, "shapes", one)
    monkeypatch.setattr(near_copies, "GROUP", 4)
    monkeypatch.setattr(near_copies, "PAIRS", 500, raising=False)
    rng = random.Random(11)
    family, texts = rng.choices(WORDS, k=90), []
    for _ in range(25):
        own = rng.choices(WORDS, k=90)
        texts += [own, changed(rng, own, 1)]
    texts += [changed(rng, family, 1) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = labels_of(near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i] for i, _ in rows] == [i - i % 2 for i in range(50)] + [50] * 20


def test_only_new_links_are_contracted(spark, monkeypatch):
    """No step contracts a link again that an earlier one had, and one without links contracts nothing."""
    whole, given = near_copies.components, []

    def seen(edges):
        given.append({(min(r), max(r)) for r in ((bytes(r.a), bytes(r.b)) for r in edges.collect())})
        return whole(edges)

    monkeypatch.setattr(near_copies, "components", seen)
    rows = planted(9)
    near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    node = [e for e in given if e]
    assert len(node) > 1 and sum(map(len, node)) == len(set().union(*node))


@pytest.mark.parametrize("few", [0, 20])
def test_many_links_give_the_same_groups(spark, monkeypatch, few):
    """Above ``FEW`` links, roots are renamed by shuffles."""
    rows = planted(9)[:500]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = labels_of(near_copies.near_groups(frame))
    for module in (near_copies, simhash):
        monkeypatch.setattr(module, "FEW", few)
    assert labels_of(near_copies.near_groups(frame)) == want and len(set(want.values())) < len(rows)


def test_many_candidates_go_by_a_filter(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL_SIDE", 10)
    rows = planted(7)[:400]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = labels_of(near_copies.near_groups(frame))
    pairs = true_pairs(rows)
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = labels_of(near_copies.near_groups(docs))
    pairs = true_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_odd_and_empty_tables(odd, empty):
    found = near_copies.near_groups(odd).collect()
    assert len(found) == odd.count()
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert got[1] == got[2] == 1 and got[4] == got[5] == got[11] == 4 and got[6] == got[7] == 6 and got[8] == got[9] == 8
    assert got[3] == 1  # 16 of 17 shingles
    assert [r.component_id for r in found if r.doc_id is None] == [1]
    assert near_copies.near_groups(empty).count() == 0
    kept = near_copies.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, c in got.items() if i == c})


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_band_keys_do_not_hang_on_order(n):
    hashes = np.array([random.Random(n + i).getrandbits(64) for i in range(n)], dtype="<u8")
    assert near_copies.band_keys(hashes) == near_copies.band_keys(hashes[::-1].copy())
    assert len(near_copies.band_keys(hashes)) == (near_copies.BANDS if n else 0)
