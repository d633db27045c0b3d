"""Near copies by word shingles: groups of texts whose sets of shingles have a Jaccard similarity of at least 0.8.

SimHash alone can't give them: pairs at 0.8 lie 3 to 15 of 64 bits apart, and Hamming balls of that radius leave no selective key.  So

1. texts whose shingles' SimHash fingerprints link (:mod:`.simhash`, multi-index hashing, complete distances verified) are one group;
2. further candidates share one of ``BANDS`` bands of ``ROWS`` minima over their shingles' hashes: a pair at 0.8 shares one with
   probability 0.998.  Candidates are compared by the exact Jaccard similarity of their whole sets, and those that reach it are linked.

Equal sets are one node.  A band's key with more than ``GROUP`` nodes is dealt into parts of about so many, by another hash for each band,
so that a large family is joined up across bands and no group or key is large.  Comparison goes in steps that each see
the groups found so far and compare only nodes of different ones: first neighbours of four bands, which joins up large families at a few
comparisons a node; then neighbours up to ``NEAR`` places apart; then whatever pairs of a key are still apart, in one part of it or
in two.  So no pair of a key is left out, and none is compared whose ends an earlier step linked: the last step compares no node of a key's largest
group with another of it, and is quadratic only in what a crowded key still holds of other groups.  A step's links join groups that are known: only
they are contracted, never all links again, and nothing is if there are none.  Pairs are compared in slices of ``PAIRS``,
so that scratch stays bounded.  Sets are made again from the texts of candidates alone, never stored for all.

Defined results: words as in :mod:`.simhash`; null text counts as empty; texts without words are one group; fewer words than a shingle: the
whole sequence is the one shingle; every row comes back, repeated rows too; null ids are kept and lose to any other as component id; texts
of any length are read whole; other columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_SIDE, joined_by_key, pruned, release, stored, trimmed
from .simhash import FEW, components, folded, keep_least, links, relabelled, shingle_hashes
from .url_filter import bloom_filter, passes_filter

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 5
GROUP = 64
NEAR = 8
PAIRS = 1 << 22

_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor%d" % i) | 1 for i in range(BANDS * ROWS)], dtype="<u8")[:, None]
_MASKS = np.array([xxhash.xxh64_intdigest(b"mask%d" % i) for i in range(BANDS * ROWS)], dtype="<u8")[:, None]
_SLICE = 2048  # hashes of a text that meet all factors at once
_HELD = 1 << 18  # hashes in an Arrow batch of sets


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of a set of shingle hashes; the band's number is hashed with its minima."""
    least = None
    for at in range(0, len(hashes), _SLICE):
        now = ((hashes[at : at + _SLICE] ^ _MASKS) * _FACTORS).min(axis=1)
        least = now if least is None else np.minimum(least, now)
    if least is None:
        return []
    raw = least.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(raw[i * ROWS * 8 : (i + 1) * ROWS * 8], i) for i in range(BANDS)]
    return np.array(keys, dtype="<u8").view("<i8").tolist()


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def _texts(docs: DataFrame, **columns: str) -> DataFrame:
    """Private columns, with ``_t``, a hash of the text by which a text is found again."""
    rows = pruned(docs, **columns)
    return rows.withColumn("_t", F.xxhash64(F.coalesce("_text", F.lit(""))))


def shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """_id, _t, _fp (SimHash), node (digest of the set of shingles), n (its size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, sizes, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                fps.append(folded(hashes))
                hashes = np.unique(hashes)
                nodes.append(_node(hashes))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(fps, dtype="<u8").view("<i8")), pa.array(nodes, pa.binary()),
                 pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=["_id", "_t", "_fp", "node", "n", "bands"],
            )

    rows = _texts(docs, _id=id_col, _text=text_col).select("_id", "_text", "_t")
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"_id {kind}, _t bigint, _fp bigint, node binary, n int, bands array<bigint>")


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of each fingerprint, and the least nodes of fingerprints that link."""
    pairs = stored(rows.select("node", "_fp").distinct(), "fingerprints")
    fps = stored(pairs.groupBy("_fp").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("_n")), "distinct")
    near = stored(links(fps.select("_fp")), "near")
    end = lambda c: fps.select(F.col("_fp").alias(c), F.col("_least").alias(f"_{c}"))
    apart = near.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = joined_by_key(pairs, fps.where("_n > 1"), "_fp", "_n").select(F.col("node").alias("a"), F.col("_least").alias("b"))
    return apart.unionAll(same).where("a != b")


def band_members(nodes: DataFrame) -> DataFrame:
    """band, key, part, parts, node, t, n for each band of a node whose key other nodes have too."""
    rows = nodes.select("node", "t", "n", F.posexplode("bands").alias("band", "key"))
    shared = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").withColumn("size", F.col("_rows")), "keys")
    parts = F.ceil(F.col("size") / GROUP)
    return joined_by_key(rows, shared, "key", "_rows").select(
        "band", "key", F.pmod(F.xxhash64("key", "node"), parts).alias("part"), parts.alias("parts"), "node", "t", "n"
    )


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b, ta, tb, ra, rb), a the lesser, of the nodes in the structs ``x`` and ``y``."""
    turned = F.col(f"{x}.node") < F.col(f"{y}.node")
    low, high = F.when(turned, F.col(x)).otherwise(F.col(y)), F.when(turned, F.col(y)).otherwise(F.col(x))
    return rows.select(low.alias("x"), high.alias("y")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.t").alias("ta"), F.col("y.t").alias("tb"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb")
    ).distinct()


def candidates(members: DataFrame, roots: DataFrame, first: int, last: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b, ta, tb, ra, rb: their groups) of nodes ``first`` to ``last`` places apart in a part, whose groups differ and whose sizes allow the similarity."""
    known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    row = F.struct(F.xxhash64("node", "key").alias("h"), "node", "t", "n", "root")
    parts = known.groupBy("key", "part").agg(F.array_sort(F.collect_list(row)).alias("l")).where(f"size(l) > {first}")
    pairs = parts.select(F.explode(F.expr(
        f"""flatten(transform(sequence({first}, least({last}, size(l) - 1)), d -> filter(
            transform(slice(l, 1, size(l) - d), (x, i) -> struct(x as a, l[i + d] as b)),
            p -> p.a.root != p.b.root and least(p.a.n, p.b.n) >= {similarity} * greatest(p.a.n, p.b.n) - 1e-9)))"""
    )).alias("p"))
    return _pairs(pairs, "p.a", "p.b")


def across(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b, ta, tb, ra, rb: their groups) of nodes in two parts of a key, whose groups differ and whose sizes allow the similarity.

    The nodes outside of a key's largest group go to all parts of the key, and meet there those of any other group.
    """
    known = stored(members.where("parts > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    groups = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    homes = groups.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("home"), F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    homes = stored(homes.where("_groups > 1").drop("_groups"), "homes")
    rows = stored(joined_by_key(known, homes, "key", "_rows"), "apart")
    node = F.struct("node", "t", "n", "root", F.col("part").alias("own"))
    others = rows.where("root != home").select("key", node.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = others.join(rows.select("key", "part", "home", node.alias("y")).hint("merge"), ["key", "part"]).where(
        f"""x.own != part and x.root != y.root and (y.root = home or x.node < y.node)
            and least(x.n, y.n) >= {similarity} * greatest(x.n, y.n) - 1e-9"""
    )
    return _pairs(met, "x", "y")


def _set_batch(nodes: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """node, set for the texts whose hash ``_t`` is in ``wanted`` (stored): broadcast if few, else texts that pass a Bloom filter are shuffled."""
    texts = _texts(docs, _text=text_col)
    size = wanted.count()
    if size <= SMALL_SIDE:
        texts = texts.join(F.broadcast(wanted), "_t", "left_semi")
    else:
        bloom, blocks = bloom_filter(wanted, size, "_t")
        one = passes_filter(texts, stored(bloom, "bloom"), blocks, "_t").groupBy("_t").agg(F.first("_text").alias("_text"))
        texts = one.join(wanted.hint("merge"), "_t", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, held = [], [], 0
            for text in batch.column(0).to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                nodes.append(_node(hashes))
                sets.append(hashes.view("<i8"))
                held += len(hashes)
                if held > _HELD:
                    yield _set_batch(nodes, sets)
                    nodes, sets, held = [], [], 0
            yield _set_batch(nodes, sets)

    made = texts.select("_text").mapInArrow(trimmed(run), "node binary, set array<bigint>")
    return made.groupBy("node").agg(F.first("set").alias("set"))


def alike(docs: DataFrame, pairs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The groups (a, b) of those of the ``pairs`` (stored) whose sets' Jaccard similarity is at least ``similarity``."""
    wanted = stored(pairs.select(F.explode(F.array("ta", "tb")).alias("_t")).distinct(), "wanted")
    sets = stored(shingle_sets(docs, wanted, text_col, shingle), "sets")
    left = pairs.select("a", "b", "ra", "rb").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    found = stored(both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "alike")
    release(wanted, sets)
    return found


def joined_up(roots: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``roots`` (stored: node, root) after the groups in the pairs of ``found`` (stored) are joined; groups of one node come in with them."""
    n = sum(f.count() for f in found)
    if not n:
        return roots
    onto = stored(components(reduce(DataFrame.unionAll, found)), "onto")
    alone = onto.join(roots.select("node"), "node", "left_anti")
    after = stored(relabelled(roots, onto, n <= FEW).unionByName(alone), "groups")
    release(onto)
    return after


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, component_id (the smallest id of its group)."""
    rows = stored(shapes(docs, id_col, text_col, shingle), "shapes")
    nodes = stored(
        rows.groupBy("node").agg(
            F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_rows"), F.min("_t").alias("t"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    members = stored(band_members(nodes), "members")
    roots = stored(components(fingerprint_links(rows)), "groups")
    crowded = not members.where("parts > 1").isEmpty()
    rest = lambda: candidates(members, roots, NEAR + 1, 1 << 30, similarity)
    steps = [
        lambda: candidates(members.where("band < 4"), roots, 1, 1, similarity),
        lambda: candidates(members, roots, 1, NEAR, similarity),
        lambda: rest().unionAll(across(members, roots, similarity)).distinct() if crowded else rest(),
    ]
    for step in steps:
        pairs = stored(step(), "pairs")
        slices = -(-pairs.count() // PAIRS)
        found = [
            alike(docs, pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i) if slices > 1 else pairs, text_col, shingle, similarity)
            for i in range(slices)
        ]
        before, roots = roots, joined_up(roots, found)
        release(pairs, *found, *([before] if roots is not before else []))
    release(members)
    grouped = stored(nodes.join(roots, "node").select("node", "_rep", "root"), "grouped")
    least = stored(grouped.groupBy("root").agg(F.min("_rep").alias("_component"), F.count(F.lit(1)).alias("_members")), "least")
    by_node = joined_by_key(grouped, least, "root", "_members").select("node", "_component")
    named = nodes.join(by_node, "node", "left").select("node", F.coalesce("_component", "_rep").alias("_component"), "_rows")
    named = stored(named, "components")
    return joined_by_key(rows.select("_id", "node"), named, "node", "_rows").select(
        F.col("_id").alias(id_col), F.col("_component").alias("component_id")
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is their group's, with all columns; rows that share an id stay or go together."""
    return keep_least(docs, near_groups(docs, id_col, text_col, shingle, similarity), id_col)
