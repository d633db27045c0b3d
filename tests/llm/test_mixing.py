import re
from collections import Counter, defaultdict

import numpy as np

from marginalia.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_share_all_words_and_stop_at_three_times():
    goal = mixing.targets([100, 100, 1], [1, 2, 3])
    assert goal[2] == 3 and abs(sum(goal) - 201) < 1e-9 and abs(goal[1] - 2 * goal[0]) < 1e-9
    assert mixing.targets([0, 5], [1, 2]) == [0.0, 5.0]
    assert mixing.targets([], []) == []


def test_shards_sum_to_the_quotas():
    quota = np.array([1000, 0, 37, 4])
    draws = mixing.draw_shards(quota, 16)
    assert (draws.sum(0) == quota).all() and (draws == mixing.draw_shards(quota, 16)).all()
    assert draws.sum(1).max() - draws.sum(1).min() <= 1


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 255, 256, 257, 5000):
        k = np.arange(n)
        out = mixing.permuted(k, np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(out) == list(k)


def corpus(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20 + i * 7 % 300)) if i % 50 else "", None if i % 11 == 0 else f"s{i % 4}") for i in range(600)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_shares_come_near_their_targets(spark):
    rows, df = corpus(spark)
    got = mixing.Mix(df).shares().collect()
    again = mixing.Mix(df.repartition(3)).shares().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    totals, goal, own = defaultdict(int), {}, Counter()
    names = {i: s for i, _, s in rows}
    for i, t, s in rows:
        own[s] += size[i]
    for r in got:
        s = names[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == own[s] and 0 <= r.taken <= 3 * r["size"]
        totals[s] += r.taken
        goal[s] = r.target
    order = sorted(own, key=lambda s: (s is None, s or ""))
    want = mixing.targets([own[s] for s in order], [1.0 + i % 3 for i in range(len(order))])
    for s, w in zip(order, want):
        assert abs(goal[s] - w) < 1e-6 * w and abs(totals[s] - w) <= 2 * mixing.BLOCK + 0.01 * w


def test_taken_words_are_those_of_the_slots(spark):
    """Brute force from the slots themselves: lay out the stream, count what each slot takes."""
    rows, df = corpus(spark)
    mix = mixing.Mix(df)
    placed = mix.placed().collect()
    counts = Counter((r._s, r["index"]) for r in mix.slots().collect())
    want = {}
    for r in placed:
        want[r._id] = sum(counts[r._s, (r._at + w) // mixing.BLOCK] for w in range(r._size))
    assert {r.doc_id: r.taken for r in mix.shares().collect()} == want
    spans = defaultdict(list)
    for r in placed:
        spans[r._s].append((r._at, r._at + r._size))
    for own in spans.values():  # the stream has no holes and no overlaps
        edge = 0
        for a, b in sorted(own):
            assert a == edge
            edge = b


def test_mixed_documents_hold_the_taken_words(spark):
    rows, df = corpus(spark)
    taken = {r.doc_id: r.taken for r in mixing.Mix(df).shares().collect()}
    wide = df.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    words = Counter()
    text = {i: t for i, t, _ in rows}
    for r in mixing.mixed_documents(wide).collect():
        assert r.n_chars == len(r.text)
        found = WORD.findall(r.text)
        assert set(found) <= set(WORD.findall(text[r.doc_id]))
        words[r.doc_id] += len(found)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_odd_rows_and_empty_table(odd, empty):
    got = mixing.Mix(odd).shares()
    assert got.count() == odd.count()
    assert all(r.taken == 0 for r in got.where("size = 0").collect())
    assert mixing.mixed_documents(odd).columns == odd.columns
    mixing.mixed_documents(odd).collect()
    assert mixing.Mix(empty).shares().count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": 3, "b": 21, "c": 40, "d": 64, "e": 100, "f": 400, "g": 1153, "h": 90_000, "i": 30_000}
    rows = []
    for s, n in sizes.items():
        for at in range(0, n, 150):
            rows.append((len(rows), " ".join(f"{s}{k}" for k in range(at, min(n, at + 150))), s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    totals, goal, name = Counter(), {}, {i: s for i, _, s in rows}
    for r in mixing.Mix(df).shares().collect():
        totals[name[r.doc_id]] += r.taken
        goal[name[r.doc_id]] = r.target
        assert r.taken <= 3 * r["size"]
    for s, w in goal.items():
        assert abs(totals[s] - w) <= max(1, 0.01 * w), (s, w, totals[s])
    assert all(goal[s] == 3 * sizes[s] == totals[s] for s in "abcdefg")
