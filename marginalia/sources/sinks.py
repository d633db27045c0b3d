"""Writers: partitioned tables for what a run makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "doc_id string, version_id string, display_label string, model string, workflow string, prompt_builder string, chunker string, chunker_params map<string,string>, n_chunks int, created_at timestamp"


def write_table(rows: DataFrame, folder: str, name: str, by: tuple[str, ...] = ("version_id",), mode: str = "overwrite", form: str = "parquet") -> None:
    """One folder per partition value; rewriting a version leaves the others alone."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(f"{folder}/{name}")


def append_meta(spark: SparkSession, folder: str, rows: DataFrame | None = None, **run) -> None:
    """Run metadata, one run by keywords or many as ``rows`` with some of the columns, stamped with the current time."""
    if rows is None:
        rows = spark.createDataFrame([{**run, "created_at": None}], META)
    known = dict(part.rsplit(" ", 1) for part in META.split(", ") if " " in part)
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in known.items() if c != "created_at"]
    rows.select(*cols, F.current_timestamp().alias("created_at")).write.mode("append").parquet(f"{folder}/run_meta")


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
