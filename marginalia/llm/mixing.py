"""Mixing sources to target weights, by blocks of tokens.

1. Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a target
   stops at ``MAX_REPEAT`` times its source's size and the excess is shared again by weight.
2. Each source's documents, in the order of a hash of id and text, are one stream of words, packed into
   blocks of ``BLOCK`` words (shorter ones in a source of few blocks, so that it too can come near its target); running sums over
   document buckets, in two levels, give each document's place without bringing a source into one task.
3. Each output shard draws the sources of its slots from a multinomial over what is still to be given,
   so that the shards' sum is each source's quota exactly.
4. The k-th slot of a source takes block P(k mod n) of its n blocks, where P is a pseudorandom
   permutation (a Feistel network with cycle walking, another for each round k div n): no block repeats
   before all others have come, so none comes more than ``MAX_REPEAT`` times.
5. Slots are joined with blocks by (source, index) after they are counted by it.

A source with a third of all rows is spread over its document buckets and blocks, an id with a third of all rows by its texts.
Sources are components of a mixture; their sizes are the only thing the driver reads, and more than ``SOURCES`` of them are refused.

Defined results: a null text has no words; documents without words are never taken; null sources form a
source of their own, the last; rows are told apart by a number of their own, so rows that repeat an id each have their own share
and their own plan (rows that repeat id, source and text alike are interchangeable); very long texts span many blocks; an empty
table, or one without words, takes nothing; other columns of any name stay with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, pruned, release, stored, trimmed

BLOCK = 128
FEW = 32  # a source that would have fewer blocks has shorter ones: about BLOCK of them, of one word at least
SHARDS = 64
MAX_REPEAT = 3
SEED = 20
BUCKET_ROWS = 512
SPAN = 4096  # buckets whose running sum one task makes
SOURCES = 1 << 16
WORDS = r"cast(size(filter(split(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), w -> w != '')) as bigint)"


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEAT) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its own size; excess goes round again."""
    total, goal = float(sum(sizes)), [0.0] * len(sizes)
    full: set[int] = {i for i, s in enumerate(sizes) if s == 0}
    while len(full) < len(sizes):
        left = total - sum(goal[i] for i in full)
        share = sum(weights[i] for i in range(len(sizes)) if i not in full)
        for i in range(len(sizes)):
            if i not in full:
                goal[i] = left * weights[i] / share
        above = {i for i in range(len(sizes)) if i not in full and goal[i] > most * sizes[i]}
        if not above:
            break
        for i in above:
            goal[i] = float(most * sizes[i])
        full |= above
    return goal


def block_length(size: int, block: int = BLOCK) -> int:
    """Words of a source's blocks."""
    return block if size >= FEW * block else max(1, size // block)


def slots_for(goal: float, size: int, blocks: int) -> int:
    """Slots that hold ``goal`` words: a source's blocks hold size / blocks words on average, its last one included."""
    return min(MAX_REPEAT * blocks, round(goal * blocks / size)) if size else 0


def draw_shards(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources slot counts: a multinomial for each shard over the quotas that are left."""
    left, out = quota.astype(np.int64).copy(), np.zeros((shards, len(quota)), dtype=np.int64)
    for j in range(shards):
        need = int(left.sum()) if j == shards - 1 else int(round(left.sum() / (shards - j)))
        rng = np.random.default_rng([seed, j])
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[j] += got
            left -= got
            need -= int(got.sum())
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P(k) for each row: a pseudorandom permutation of 0..n-1 chosen by ``key``."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    x, walking, out = k.astype(np.uint64), np.arange(len(k)), np.zeros(len(k), dtype=np.int64)
    while len(walking):
        left, right, h, m, s = x[walking] >> half[walking], x[walking] & mask[walking], half[walking], mask[walking], key[walking]
        for turn in range(4):
            f = (right + np.uint64(turn + 1)) * mix ^ s
            f = (f ^ f >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ f >> np.uint64(32)) & m)
        x[walking] = left << h | right
        done = x[walking] < n[walking].astype(np.uint64)
        out[walking[done]] = x[walking[done]]
        walking = walking[~done]
    return out


class Mix:
    """A planned mixture: its documents' places, its blocks' counts and its documents' shares."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, row_col: str | None = None):
        """``row_col``: a column that numbers the rows; without one they are numbered as they are first read."""
        self.spark, self.seed, self.id_col = docs.sparkSession, seed, id_col
        rows = pruned(docs, _id=id_col, _text=text_col, _source=source_col, **({"_row": row_col} if row_col else {}))
        rows = rows if row_col else rows.withColumn("_row", F.monotonically_increasing_id())
        size = F.expr(WORDS.format("_text")).alias("_size")
        order = F.xxhash64("_id", F.xxhash64("_text"), F.lit(seed)).alias("_h")
        self.sizes = stored(rows.select("_row", "_id", "_source", size, order), "sizes")
        by_source = stored(self.sizes.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows")), "sources")
        if by_source.count() > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        found = by_source.collect()
        release(by_source)
        found.sort(key=lambda r: (r._source is None, r._source or ""))  # code points; null last
        self.names = [r._source for r in found]
        self.size = [r["size"] for r in found]
        self.goal = targets(self.size, [1.0 + i % 3 for i in range(len(found))])
        self.lengths = [block_length(s, block) for s in self.size]
        self.blocks = [-(-s // n) for s, n in zip(self.size, self.lengths, strict=True)]
        quota = np.array([slots_for(*x) for x in zip(self.goal, self.size, self.blocks, strict=True)], dtype=np.int64)
        self.draws = draw_shards(quota, shards, seed) if len(quota) and quota.sum() else np.zeros((shards, len(quota)), dtype=np.int64)
        self.buckets = max(1, sum(r["rows"] for r in found) // BUCKET_ROWS)
        places = [
            (i, name, int(size), float(goal), int(n))
            for i, (name, size, goal, n) in enumerate(zip(self.names, self.size, self.goal, self.lengths, strict=True))
        ]
        self.sources = F.broadcast(  # one row for each of at most SOURCES sources
            self.spark.createDataFrame(places, "_s int, _name string, _source_size long, _target double, _block long")
        )

    def slots(self) -> DataFrame:
        """The mixture itself, one row per output block: shard, source number, slot of the source, index of the block."""
        before = np.cumsum(self.draws, axis=0) - self.draws
        draws = [
            (j, s, int(before[j, s]), int(self.draws[j, s]), int(self.blocks[s]))
            for j in range(self.draws.shape[0])
            for s in range(self.draws.shape[1])
            if self.draws[j, s]
        ]
        step = 1 << 14  # slots come out of pieces of bounded size
        counts = self.spark.createDataFrame(draws, "shard int, _s int, first long, n long, blocks long")
        pieces = counts.select("shard", "_s", "first", "n", "blocks", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)")).alias("at"))
        pieces = pieces.repartition(max(1, min(int(self.draws.sum()) // step, 4096)))
        seed = self.seed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for p in batch.itertuples(index=False):
                    k = p.first + p.at + np.arange(min(step, p.n - p.at), dtype=np.int64)
                    rounds = (k // p.blocks).astype(np.uint64)
                    key = (rounds * np.uint64(1_000_003) + np.uint64(p[1] * 8191 + seed)) * np.uint64(0xD6E8FEB86659FD93)
                    index = permuted(k % p.blocks, np.full(len(k), p.blocks), key)
                    yield pd.DataFrame({"shard": p.shard, "_s": p[1], "slot": k, "index": index})

        return pieces.mapInPandas(trimmed(run), "shard int, _s int, slot long, index long")

    def placed(self) -> DataFrame:
        """Documents with their source's number and their first word's place in its stream (_at)."""
        named = self.sizes.join(self.sources, F.col("_source").eqNullSafe(F.col("_name")))
        rows = named.select("_row", "_id", "_s", "_size", "_source_size", "_target", "_block", "_h")
        rows = rows.withColumn("_bucket", F.pmod("_h", F.lit(self.buckets)))
        sums = rows.groupBy("_s", "_bucket").agg(F.sum("_size").alias("_sum")).withColumn("_span", F.floor(F.col("_bucket") / SPAN))
        spans = sums.groupBy("_s", "_span").agg(F.sum("_sum").alias("_all"))
        before = lambda c, by, order: F.sum(c).over(Window.partitionBy(*by).orderBy(order)) - F.col(c)
        spans = spans.select("_s", "_span", before("_all", ["_s"], "_span").alias("_first"))
        sums = sums.withColumn("_before", before("_sum", ["_s", "_span"], "_bucket")).join(spans, ["_s", "_span"])
        sums = sums.select("_s", "_bucket", (F.col("_first") + F.col("_before")).alias("_before"))
        within = Window.partitionBy("_s", "_bucket").orderBy("_h", "_id", "_size", "_row").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_in", F.sum("_size").over(within) - F.col("_size"))
        return rows.join(sums, ["_s", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_bucket", "_h", "_in", "_before")

    def pieces(self) -> DataFrame:
        """A row for each document and block it has words in: what of it, and how often the mix takes it (_n)."""
        b = F.col("_block")
        rows = stored(self.placed(), "placed")
        cut = rows.where("_size > 0").select(
            "_row", "_id", "_s", "_at", "_size", "_block", F.explode(F.expr("sequence(_at div _block, (_at + _size - 1) div _block)")).alias("index")
        )
        first, last = F.greatest(F.col("index") * b, F.col("_at")), F.least((F.col("index") + 1) * b, F.col("_at") + F.col("_size"))
        cut = cut.select("_row", "_id", "_s", "index", (first - F.col("_at")).alias("_from"), (last - F.col("_at")).alias("_to"))
        taken = self.slots().groupBy("_s", "index").agg(F.count(F.lit(1)).alias("_n"))
        self.rows = rows
        return cut.join(taken, ["_s", "index"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("long"))

    def shares(self) -> DataFrame:
        """One row per input row: id, size, source_size, target, taken."""
        pieces = self.pieces()
        taken = pieces.groupBy("_row").agg(F.sum(F.col("_n") * (F.col("_to") - F.col("_from"))).alias("_taken"))
        return self.rows.join(taken, "_row", "left").select(
            F.col("_id").alias(self.id_col),
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
        )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    length_col: str = "n_chars", **params) -> DataFrame:
    """The mixture as rows of ``docs``: a document comes once for each round that takes words of it, with
    the words that the round takes; where a round takes the whole document its text is unchanged.

    A document in several blocks may be taken in part.  Then the parts' text, from the first to past the
    last word of each, is joined by a line break; ``length_col`` follows the new text.
    """
    row, plan_row, plan, size = fresh(docs, "_mix_row", "_mix_plan_row", "_mix_spans", "_mix_size")
    whole = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # a row's number holds for its share and its text
    mix = Mix(whole, id_col, text_col, source_col, row_col=row, **params)
    pieces = mix.pieces().where("_n > 0")
    spans = pieces.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_n"))).alias("_spans"))
    plans = spans.join(mix.rows.select("_row", "_size"), "_row").select(
        F.col("_row").alias(plan_row), F.col("_spans").alias(plan), F.col("_size").alias(size)
    )
    joined = whole.join(plans, F.col(row) == F.col(plan_row))
    names, types = docs.columns, docs.schema
    width, text_at = len(names), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            rows, texts = [], []
            plans, sizes = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            bodies = batch.column(text_at).to_pylist()
            for i, (spans, n, body) in enumerate(zip(plans, sizes, bodies, strict=True)):
                ends = None
                for turn in range(1, MAX_REPEAT + 1):
                    parts: list[list[int]] = []
                    for s in spans:
                        if s["_n"] >= turn:
                            if parts and parts[-1][1] == s["_from"]:
                                parts[-1][1] = s["_to"]
                            else:
                                parts.append([s["_from"], s["_to"]])
                    if not parts:
                        break
                    rows.append(i)
                    if parts == [[0, n]]:
                        texts.append(body)
                    else:
                        ends = ends or [m.span() for m in word.finditer(body)]
                        texts.append("\n".join(body[ends[a][0] : ends[b - 1][1]] for a, b in parts))
            out = batch.take(pa.array(rows, pa.int64()))
            columns = [
                pa.array(texts, pa.string()) if n == text_col
                else pa.array([len(t) for t in texts], out.column(n).type) if n == length_col
                else out.column(n)
                for n in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*(F.col(f"`{n}`") for n in names), plan, size).mapInArrow(trimmed(run), types)
