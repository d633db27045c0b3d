"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprint: words are cut at ASCII white space after A-Z are lower-cased; each run of ``shingle`` words
(repeats included) is hashed by XXH64 with seed 42, and a bit is set if it is set in over half the
hashes.  Fewer words than a shingle: the whole sequence is the one shingle; none: fingerprint zero.

Links (at most 2 differing bits) are found among *distinct* fingerprints, so copies cost nothing:

1. A fingerprint has two segments of 32 bits.  Two fingerprints within distance 2 have equal high
   segments, or else low segments within distance 1.  Tables hold the exact segments; probes are the
   Hamming ball of radius 0 in the high and 1 in the low segment.  Of the low ball only flips from 0
   to 1 are probed: the other end of a pair at distance 1 makes up for the rest.
2. Matches of a table key are verified by the complete distance.
3. A key with far more rows than chance brings (``KEY_ROWS``, and past some billion fingerprints ``KEY_LOAD`` times the mean
   load of a key, so that a larger corpus does not leave the tables) is a large family of near copies and not paired up.  Its
   fingerprints go through an exact linear way instead: each emits the 65 words within distance 1 of it
   ("centres").  Fingerprints that share a centre are within distance 2 of each other, and any two
   within distance 2 share one; so linking each to its centre's smallest loses no connection, and a
   centre can have 65 members at most, whatever the family's size.

Components of the links are contracted in rounds; each round is written to the shared scratch folder.

Defined results: null text counts as empty; every row comes back, repeated rows too; null ids are kept
and lose to any other as component id; texts of any length are hashed whole; other columns of any name are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, joined_by_key, pruned, release, stored, without

SHINGLE = 3
SEED = 42
KEY_ROWS = 32
KEY_LOAD = 4
FEW = 1 << 16  # edges whose ends are renamed by a broadcast table, at most two rows for each
PROBES = 17  # rows that a fingerprint has in the low table on average: itself and half of 32 flips


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit hashes of a whole text's shingles, in order."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype="<u8")
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    return np.array([digest(b" ".join(run), SEED) for run in runs], dtype="<u8")


def folded(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    # bytes can count to 255, and adding bytes is what vector units do best
    full = n - n % 255
    ones = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns _id and _fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], names=["_id", "_fp"])

    rows = pruned(docs, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _fp bigint")


def key_bound(n: int, key_rows: int = KEY_ROWS) -> int:
    """Rows of a table key beyond which ``n`` distinct fingerprints leave it for the linear way."""
    return max(key_rows, -(-KEY_LOAD * PROBES * n // (1 << 32)))


def links(fps: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``_fp`` within distance 2."""
    key_rows = key_bound(fps.count(), key_rows)
    low = "(_fp & 4294967295)"
    high = "shiftrightunsigned(_fp, 32)"
    rows = fps.select(
        "_fp",
        F.expr(
            f"""explode(concat(
            array(named_struct('key', {low}, 'probe', false), named_struct('key', {high} + 4294967296, 'probe', false)),
            transform(filter(sequence(0, 31), i -> ({low} & shiftleft(1L, i)) = 0),
                      i -> named_struct('key', {low} | shiftleft(1L, i), 'probe', true))))"""
        ).alias("_row"),
    ).select("_fp", "_row.key", "_row.probe")

    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("p"))
    crowded = stored(crowded.where(F.col("n") > key_rows), "crowded")  # p: no table row, so nothing to match

    matches = (
        rows.join(crowded, "key", "left_anti")
        .groupBy("key")
        .agg(
            F.collect_list(F.when(~F.col("probe"), F.col("_fp"))).alias("table"),
            F.collect_list("_fp").alias("all"),
        )
        .where("size(table) > 0 and size(all) > 1")
        .select(F.explode("table").alias("a"), "all")
    )
    near = "explode(filter(all, b -> b != a and bit_count(a ^ b) <= 2))"
    paired = matches.select("a", F.expr(near).alias("b"))

    family = rows.join(crowded.where(~F.col("p")), "key", "left_semi").select("_fp").distinct()
    centres = family.select(
        F.col("_fp").alias("a"),
        F.expr("explode(concat(array(_fp), transform(sequence(0, 63), i -> _fp ^ shiftleft(1L, i))))").alias("centre"),
    )
    starred = centres.withColumn("b", F.min("a").over(Window.partitionBy("centre"))).where("a != b").select("a", "b")
    return paired.unionAll(starred).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node -> root for every node of ``edges``, by rounds of contraction.

    In a round each node goes to the neighbour (or itself) of least hash, and edges are rewritten;
    the hash order makes long chains shrink by a constant factor.  Loops go, and repeated edges while there are more than ``FEW``;
    what is left then is rewritten by broadcast moves, without a shuffle.
    """
    edges = stored(edges, "edges")
    moves: list[tuple[DataFrame, bool]] = []
    while n := edges.count():
        few = n <= FEW
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count(F.lit(1)).alias("size"))
        move = stored(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("root"), "size"), "move")
        moves.append((move, few))
        ends = lambda c: move.select(F.col("node").alias(c), F.col("root").alias("to"), "size")  # noqa: B023, E731
        step = lambda rows, c: rows.join(F.broadcast(ends(c)), c) if few else joined_by_key(rows, ends(c), c, "size")  # noqa: B023, E731
        first = step(edges, "a").select(F.col("to").alias("a"), "b")
        second = step(first, "b").select("a", F.col("to").alias("b")).where("a != b")
        turned = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        before, edges = edges, stored(turned if few else turned.distinct(), "edges")
        release(before)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = moves[0][0].select("node", "root")
    for move, few in moves[1:]:
        labels = relabelled(labels, move, few) if few else stored(relabelled(labels, move, few), "labels")
    return labels


def relabelled(labels: DataFrame, move: DataFrame, few: bool) -> DataFrame:
    """``labels`` (node, root) whose roots go where ``move`` (node, root; broadcast if ``few``) takes them."""
    to = move.select(F.col("node").alias("root"), F.col("root").alias("to"))
    if few:
        found = labels.join(F.broadcast(to), "root", "left")
    else:
        sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        found = joined_by_key(labels, stored(sizes.join(to, "root"), "steps"), "root", "size", "left")
    return found.select("node", F.coalesce("to", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = stored(rows.groupBy("_fp").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")), "distinct")
    roots = stored(components(links(fps.select("_fp"))), "roots")
    labelled = fps.join(roots, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_rep", "_n", F.coalesce("root", "_fp").alias("_root")
    )
    least = labelled.groupBy("_root").agg(F.min("_rep").alias("_component"), F.count(F.lit(1)).alias("_members"))
    labelled = stored(joined_by_key(labelled, least, "_root", "_members").select("_fp", "_component", "_n"), "components")
    release(roots)
    return joined_by_key(rows, labelled, "_fp", "_n").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's: one document of each group, with all columns, whatever their names.

    Rows that share an id stay or go together.  Texts are not shuffled while the ids that go are few, see :func:`without`.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is their component's in ``found`` (a row for each of theirs: id, component_id)."""
    found = found.select(F.col(f"`{id_col}`").alias("_id"), "component_id")
    ids = found.groupBy("_id").agg(F.max(F.col("_id").eqNullSafe(F.col("component_id"))).alias("_stays"))
    (name,) = fresh(docs, "_gone_id")
    gone = stored(ids.where("not _stays").select(F.col("_id").alias(name)), "gone")
    own = F.col(f"`{id_col}`")
    left = without(docs.where(own.isNotNull()), gone.where(F.col(name).isNotNull()), own == F.col(name))
    return left if not gone.where(F.col(name).isNull()).isEmpty() else left.unionByName(docs.where(own.isNull()))
