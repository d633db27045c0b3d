"""Lines that many documents share go, but for one document: a range partitioning of line hashes, read as a stream.

1. One pass over the texts makes a row of each long line: 128 bits of hash of its key, document, text hash and place (some 45 bytes, kept;
   no text).
2. These rows are dealt by ranges of (hash, document descending, place) and sorted.  Since the document is part of the range, a line
   that a third of all documents share lies over many partitions.
3. Each partition is read once, in order, by :class:`Runs`: the first document of a run keeps the line, and from the fifth document
   on the rest is known to drop.  What it holds at any time is a batch and the lines of at most ``least - 1`` documents.
   A run at a partition's edge may go on in the next one: its lines come out undecided, with the first ``least`` documents of the piece.
4. These pieces, at most two a partition, are brought together by hash (a few rows for each partition, which bounds the broadcast) and
   decide the rest.
5. Dropped places become one bitmap for each document (a bit for each line, 1 stays, compressed); bitmaps, not texts, come back to the
   documents: broadcast if they are few, else only rows whose key a Bloom filter of the bitmaps lets through are shuffled.

Defined results: a null or empty text is one empty line; documents are told apart by id, so rows that repeat an id are one document, and each
row loses the lines of its own text; a null id is a document of its own, below all others (it counts as the least long);
of equal largest ids every row keeps its lines; texts and lines of any length are read whole; an empty table gives an empty result;
other columns of any name are kept or ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from . import shared
from .shared import fresh, joined_by_key, scratch_scope, small_batches, stored
from .url_filter import bloom_filter, passes_filter

LEAST_CHARS, LEAST_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
SMALL_BYTES = 64 << 20
DROP, OPEN, PIECE = 0, 1, 2
FIELDS = ("h1", "h2", "doc", "tx", "pos")
LINES = ", ".join(f"{c} long" for c in FIELDS)


def line_key(line: Column) -> Column:
    """What lines are compared by: without blanks at either end, A-Z in lower case.  ASCII lines take the faster way to the same."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALLS))


def _doc(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(NO_ID))


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`"), F.lit(""))


def long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """h1, h2, doc, tx, pos of every line whose key is long enough."""
    rows = docs.select(_doc(id_col).alias("doc"), F.xxhash64(_text(text_col)).alias("tx"), F.posexplode(F.split(_text(text_col), "\n")).alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= least_chars).select("doc", "tx", F.col("pos").cast("long").alias("pos"), line_key(F.col("line")).alias("key"))
    return rows.where(F.char_length("key") >= least_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "tx", "pos")


class Runs:
    """The lines of one sorted partition as they come: ``add`` a table of columns, then ``end``; ``out`` has rows with a verdict."""

    def __init__(self, least: int):
        self.least, self.out = least, []
        self.key = None  # of the run that is open
        self.first = True  # it may have begun in the partition before
        self.held = None  # its lines so far, while it is undecided
        self.docs: list[int] = []  # its first documents

    def _emit(self, rows: np.ndarray, verdict: int) -> None:
        if rows.shape[1]:
            self.out.append((verdict, rows))

    def _piece(self) -> None:
        own = np.zeros((5, len(self.docs)), np.int64)
        own[0], own[1], own[2] = self.key[0], self.key[1], self.docs
        self._emit(own, PIECE)

    def _see(self, docs: np.ndarray) -> None:
        """Add the first documents of ``docs`` (sorted descending) to the open run's."""
        if docs.size and len(self.docs) < self.least:
            new = docs[np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])]
            self.docs += [int(d) for d in new if d not in self.docs[-1:]][: self.least - len(self.docs)]

    def add(self, rows: np.ndarray) -> None:
        """``rows``: h1, h2, doc, tx, pos by line of the table."""
        if self.key is None and rows.shape[1]:
            self.key = (rows[0, 0], rows[1, 0])
        if self.held is None:  # the open run is the partition's first, or is decided
            other = np.flatnonzero((rows[0] != self.key[0]) | (rows[1] != self.key[1])) if rows.shape[1] else []
            n = int(other[0]) if len(other) else rows.shape[1]
            self._see(rows[2, :n])
            self._emit(rows[:, :n], OPEN if self.first else DROP)
            rows = rows[:, n:]
            if not rows.shape[1]:
                return
            if self.first:
                self._piece()
            self.first = False
        else:
            rows = np.concatenate([self.held, rows], axis=1)
        if not rows.shape[1]:
            return
        at = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])  # where runs begin
        run = np.repeat(np.arange(at.size), np.diff(np.r_[at, rows.shape[1]]))
        new = np.r_[True, rows[2, 1:] != rows[2, :-1]]
        new[at] = True
        rank = np.cumsum(new)
        rank -= rank[at][run]  # documents before this one in the run
        n_docs = np.zeros(at.size, np.int64)
        np.maximum.at(n_docs, run, rank + 1)
        self._emit(rows[:, (n_docs[run] >= self.least) & (rank > 0)], DROP)
        self.key, self.docs = (rows[0, -1], rows[1, -1]), []
        self._see(rows[2, at[-1] :])
        self.held = None if n_docs[-1] >= self.least else rows[:, at[-1] :].copy()

    def end(self) -> None:
        if self.key is not None:
            if self.held is not None:
                self._emit(self.held, OPEN)
            self._piece()

    def taken(self) -> Iterator[pa.RecordBatch]:
        for verdict, rows in self.out:
            yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(np.full(rows.shape[1], verdict, np.int32))], names=[*FIELDS, "verdict"])
        self.out = []


def _streamed(least: int):
    def read(batches):
        runs = Runs(least)
        for batch in batches:
            if batch.num_rows:
                runs.add(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                yield from runs.taken()
        runs.end()
        yield from runs.taken()

    return read


def dropped_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """doc, tx, pos of the lines (stored) that go, once for each row that has them."""
    keys = ["h1", "h2", F.desc("doc"), "tx", "pos"]
    tie = lines.withColumn("_tie", F.monotonically_increasing_id())  # deals out rows that repeat wholly
    dealt = tie.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    told = stored(dealt.mapInArrow(_streamed(least_docs), f"{LINES}, verdict int"), "told")
    pieces = told.where(F.col("verdict") == PIECE).groupBy("h1", "h2").agg(F.count_distinct("doc").alias("_docs"), F.max("doc").alias("_keeper"))
    late = told.where(F.col("verdict") == OPEN).join(F.broadcast(pieces.where(F.col("_docs") >= least_docs)), ["h1", "h2"]).where("doc != _keeper")
    return told.where(F.col("verdict") == DROP).select("doc", "tx", "pos").unionByName(late.select("doc", "tx", "pos"))


@F.pandas_udf(BinaryType())
def packed(places: pd.Series) -> pd.Series:
    """The compressed bitmap of lines that stay; lines past its end stay too."""

    def one(at):
        bits = np.ones(int(max(at)) // 8 * 8 + 8, bool)
        bits[np.asarray(at, np.int64)] = False
        return zlib.compress(np.packbits(bits).tobytes())

    return places.map(one)


@F.pandas_udf(StringType())
def cut_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines that a bitmap keeps; null where there is no bitmap."""

    def one(t, k):
        if k is None or t is None:
            return None
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8)).tolist()
        lines = t.split("\n")
        bits += [1] * (len(lines) - len(bits))
        return "\n".join(x for x, b in zip(lines, bits) if b)

    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, tx (id and text hash), keep (the bitmap), n_dropped and n_rows (how many rows have this id and text) of texts that lose lines."""
    with scratch_scope(docs.sparkSession) as keep:
        lines = stored(long_lines(docs, id_col, text_col, least_chars), "lines")
        gone = dropped_lines(lines, least_docs).groupBy("doc", "tx").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.count(F.lit(1)).alias("n"))
        found = stored(gone.select("doc", "tx", packed("at").alias("keep"), F.size("at").cast("long").alias("n_dropped"), F.expr("n div size(at)").alias("n_rows")), "bitmaps")
        keep.append(found)
    return found


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four columns more, and their names: text (what stays), n_lines, n_dropped, keep (null where nothing goes)."""
    small_batches(docs.sparkSession)
    maps = keep_bitmaps(docs, id_col, text_col, least_chars, least_docs)
    doc, tx, keep, dropped, left, n_lines = fresh(docs, "_doc", "_tx", "_keep", "_n_dropped", "_left", "_n_lines")
    rows = docs.withColumn(doc, _doc(id_col)).withColumn(tx, F.xxhash64(_text(text_col)))
    size = maps.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("keep")), F.lit(0)).alias("b")).first()
    if size.n <= shared.SMALL_SIDE and size.b <= SMALL_BYTES:
        named = maps.select(F.col("doc").alias(doc), F.col("tx").alias(tx), F.col("keep").alias(keep), F.col("n_dropped").alias(dropped))
        met = rows.join(F.broadcast(named), [doc, tx], "left")
    else:
        rows = rows.select(F.struct("*").alias("_row"), F.xxhash64(doc, tx).alias("_key"))
        entries = stored(maps.withColumn("_key", F.xxhash64("doc", "tx")), "entries")
        bloom, blocks = bloom_filter(entries, size.n)
        bloom = stored(bloom, "bloom")
        table = entries.groupBy("_key").agg(F.sum("n_rows").alias("_rows"), F.collect_list(F.struct("doc", "tx", "keep", "n_dropped")).alias("_all"))  # one, but for hashes that clash
        hit = joined_by_key(passes_filter(rows, bloom, blocks), stored(table, "by_key"), "_key", "_rows", "left")
        rest = passes_filter(rows, bloom, blocks, passes=False)
        own = F.filter("_all", lambda x: (x["doc"] == F.col(f"_row.{doc}")) & (x["tx"] == F.col(f"_row.{tx}")))
        met = hit.select("_row", F.get(own, F.lit(0)).alias("_own")).unionByName(rest.select("_row"), allowMissingColumns=True)
        met = met.select("_row.*", F.col("_own.keep").alias(keep), F.col("_own.n_dropped").alias(dropped))
    text = _text(text_col)
    short = cut_text(F.when(F.col(keep).isNotNull(), text), F.col(keep))
    met = met.withColumn(left, F.coalesce(short, text)).withColumn(dropped, F.coalesce(dropped, F.lit(0).cast("long")))
    met = met.withColumn(n_lines, (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    return met.drop(doc, tx), {"text": left, "n_lines": n_lines, "n_dropped": dropped, "keep": keep}


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with their texts cut, in the same columns; a null text stays null."""
    cut, names = cut_lines(docs, id_col, text_col, **params)
    kept = F.when(F.col(f"`{text_col}`").isNotNull(), F.col(names["text"]))
    return cut.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
