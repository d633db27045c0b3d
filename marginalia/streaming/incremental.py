"""Incremental runs over arriving documents (an addition: the batch engine has no streams of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keywords import find_hits
from ..operators.sentences import build_index


def content_hash(text: str = "text") -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def new_content(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose (doc_id, content hash) is not among ``done``."""
    return docs.withColumn("content_hash", content_hash()).join(done.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def stream_hits(docs: DataFrame, keywords: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Index arriving documents and write their keyword hits, one folder per batch, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        find_hits(build_index(batch), keywords).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(docs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Each content once while it is within the watermark; state is bounded by the delay."""
    return docs.withColumn("content_hash", content_hash()).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])
