import random

import xxhash
from pyspark.sql import functions as F

from marginalia.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = sorted({fp for _, fp in rows})
    parent = {fp: fp for fp in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return {(i, fp): least.get(find(fp)) for i, fp in rows}


def test_fingerprints_equal_brute_force(odd):
    rows = simhash.fingerprints(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((repr(r._id), r._fp & (2**64 - 1)) for r in rows) == sorted((repr(i), brute_fingerprint(t)) for i, t in texts)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.hex(F.xxhash64(F.lit("one two three")))).first()[0]
    assert int(got, 16) == xxhash.xxh64_intdigest("one two three", 42)


def graph(spark, fps, key_rows):
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps]
    edges = simhash.links(spark.createDataFrame(signed, "_fp long"), key_rows)
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(edges).collect()}
    return {fp: roots.get(fp, fp) for fp in fps}


def test_links_with_and_without_crowded_keys(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:6]:
        for _ in range(60):  # families of near copies, chains among them
            x = centre
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(list(zip(fps, fps)))
    for key_rows in (2, 8, 10_000):
        roots = graph(spark, fps, key_rows)
        groups = {}
        for fp, root in roots.items():
            groups.setdefault(root, set()).add(fp)
        expected = {}
        for (fp, _), root in want.items():
            expected.setdefault(root, set()).add(fp)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert len({r.root for r in simhash.components(edges).collect()}) == 1


def test_query_equals_brute_force(odd, empty):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()]
    want = brute_components(rows)
    got = simhash.near_duplicates(odd).collect()
    assert sorted(repr((r.doc_id, int(r.fingerprint, 16), r.component_id)) for r in got) == sorted(
        repr((i, fp, want[i, fp])) for i, fp in rows
    )
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for (i, _), c in want.items() if i == c}
