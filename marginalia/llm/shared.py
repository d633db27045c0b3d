"""What the operators share: scratch tables in the folder that all executors share (``spark.checkpoint.dir``), and joins
whose hot keys or small sides are kept out of shuffles."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

_scopes: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone: the folder's owner cleans it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`shared_dir`, removed with its scope, else when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for scope in _scopes[-1:]:
        scope.append(path)
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a scratch folder and read it again.

    This cuts the lineage like a checkpoint, survives the loss of executors, and is read with
    column pruning by the several consumers of one intermediate result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def release(*frames: DataFrame) -> None:
    """Remove the folders of stored frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _remove(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Scratch that is made inside is removed at the end, but for the stored frames that are put into the list."""
    keep: list[DataFrame] = []
    _scopes.append([])
    try:
        yield keep
    finally:
        made, kept = _scopes.pop(), {getattr(df, "_scratch", None) for df in keep}
        for path in made:
            if path not in kept:
                _remove(spark, path)
            elif _scopes:
                _scopes[-1].append(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys that a join may take out of its shuffle, and rows that an anti-join may broadcast: a few dozen MB at most.
HEAVY_KEYS = 1 << 14
HEAVY_ROWS = 64
SMALL_SIDE = 1 << 18


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key and in ``size`` how many rows have it; ``how`` is inner or left.

    Keys with at least ``HEAVY_ROWS`` rows and a ``HEAVY_KEYS``-th of all rows, so at most ``HEAVY_KEYS`` keys, are broadcast and
    joined on the map side; no key of the shuffle is larger.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    least = max(HEAVY_ROWS, -(-total // HEAVY_KEYS))
    heavy = table.where(F.col(size) >= least).drop(size)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.where(F.col(size) < least).drop(size), key, how)
    return hot.unionByName(rest)


def without(rows: DataFrame, gone: DataFrame, on, how: str = "left_anti") -> DataFrame:
    """``rows`` without those that ``gone`` (stored) has; ``gone`` is broadcast if it has at most ``SMALL_SIDE`` rows, else both are shuffled."""
    small = gone.count() <= SMALL_SIDE
    return rows.join(F.broadcast(gone) if small else gone.hint("merge"), on, how)


def hash_sample(rows: DataFrame, n: int, of: int, column: str, seed: int) -> DataFrame:
    """The ``n`` rows of about ``of`` with the least hashes of ``column``.

    A cut on the hash leaves some 4 n rows before they are ordered, so that tasks do not each send n of theirs.
    """
    hashed = F.xxhash64(F.col(column), F.lit(seed))
    if of > 4 * n:
        rows = rows.where(hashed < F.lit(int(-(2**63) + 2**64 * (4 * n / of))))
    return rows.orderBy(hashed, column).limit(n)


#: Documents can be long, so an Arrow batch holds far fewer than the default 10,000 of them.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; a lower setting of the user's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at its end freed memory goes back to the system, since Python workers live on into the next stage's tasks."""

    def task(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not the GNU C library
                pass

    return task


def pruned(docs: DataFrame, **columns: str) -> DataFrame:
    """Select the needed columns under private names, so that no other column can clash."""
    small_batches(docs.sparkSession)
    return docs.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
