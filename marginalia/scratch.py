"""Intermediate results that several branches of a plan read: written once to the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no checkpoint folder, as in tests.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder as a URI; one is set only where there is none, and only in a local session.

    Spark makes this folder for one session, below the one that is named; it is removed with all that lies in it when the driver ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or LOCAL_FALLBACK)
    found = sc.getCheckpointDir()
    if found not in _owned:
        _owned.add(found)
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder below :func:`shared_dir` that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_file(lines: DataFrame, path: str) -> str:
    """Write the one text column of a small frame as one file of that name, in the order of its rows."""
    spark, parts = lines.sparkSession, f"{path}-parts"
    lines.coalesce(1).write.text(parts)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(hadoop(parts)) if f.getPath().getName().startswith("part-"))
    files.mkdirs(hadoop(path).getParent())
    files.rename(part, hadoop(path))
    files.delete(hadoop(parts), True)
    return path


#: Spark's own setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def holding(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for what is done within; then as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` from its checkpoint: lineage is cut, how it is partitioned is known to later joins, and nothing stays in executors' memory.

    The shuffles that made it are not read again, so their files go at once; the setting for that holds for this query alone.
    """
    shared_dir(df.sparkSession)
    with holding(df.sparkSession, CLEANUP, "true"):
        return df.select("*").checkpoint()  # a frame takes the setting from when it is made


def dropped(*frames: DataFrame) -> None:
    """Remove the checkpoints of settled frames that nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
