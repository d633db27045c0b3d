"""Exports and run reports as tables, and their writers."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import params_text, path_token


def split_index(rows: DataFrame, company: str = "company", year: str = "year", accession: str = "accession") -> DataFrame:
    """company, year, accession, n_rows, path: one file for each filing, with the accession in its name only where a
    (company, year) has several."""
    groups = rows.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((company, "company"), (year, "year"), (accession, "accession")))).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    many = F.count(F.lit(1)).over(Window.partitionBy("company", "year")) > 1
    folder, when = path_token(F.col("company")), path_token(F.col("year"))
    tail = F.when(many, F.concat(F.lit("_"), path_token(F.col("accession")))).otherwise("")
    label = F.when(many, F.concat("year", F.lit(" ("), "accession", F.lit(")"))).otherwise(F.col("year"))
    return groups.select("company", "year", "accession", "n_rows", label.alias("label"), F.concat(folder, F.lit("/"), folder, F.lit("_"), when, tail, F.lit(".csv")).alias("path"))


def write_split(rows: DataFrame, folder: str, company: str = "company", year: str = "year", accession: str = "accession") -> DataFrame:
    """Write rows partitioned by file path (CSV, quotes doubled) and return the index; the folder is rebuilt."""
    index = split_index(rows, company, year, accession)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (company, year, accession)]
    named = rows.withColumns({"_c": key[0], "_y": key[1], "_a": key[2]}).join(
        index.select(F.col("company").alias("_c"), F.col("year").alias("_y"), F.col("accession").alias("_a"), F.regexp_replace("path", "/", "__").alias("file")), ["_c", "_y", "_a"]
    )
    named.drop("_c", "_y", "_a").repartition("file").write.mode("overwrite").partitionBy("file").option("header", True).option("escape", '"').csv(folder)
    return index


def index_lines(index: DataFrame) -> DataFrame:
    """company, line: one markdown line per company with its years in order; companies sort without case."""
    link = F.concat(F.lit("["), "label", F.lit("]("), "path", F.lit(")"))
    years = F.array_sort(F.collect_list(F.struct("label", link.alias("l"))))
    rows = index.groupBy("company").agg(years.alias("y"))
    return rows.select("company", F.lower("company").alias("sort"), F.concat(F.lit("- **"), "company", F.lit("** — "), F.array_join("y.l", " · ")).alias("line"))


def ai_rows(cards: DataFrame, sources: DataFrame, sentences: DataFrame) -> DataFrame:
    """Cards on anchors that the machine alone tagged, in order, and all its unmatched cards."""
    alone = sources.where("source = 'ai'").select("doc_id", "anchor_id")
    ai = cards.drop("sentence_idx").where("side = 'ai'")
    at = sentences.select("doc_id", "anchor_id", F.col("sentence_idx").alias("place"), "text")
    matched = ai.join(alone, ["doc_id", "anchor_id"], "left_semi").join(at, ["doc_id", "anchor_id"], "left")
    loose = ai.where("anchor_id is null").select("*", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("text"))
    rows = matched.select(*loose.columns).unionByName(loose)
    return rows.select(
        "doc_id", F.coalesce("anchor_id", F.lit("(unmatched)")).alias("anchor_id"), F.coalesce("text", "sentence_excerpt").alias("sentence"), "kind", "category", "subcategory",
        F.coalesce(F.col("strength").cast("string"), F.lit("")).alias("strength"), F.coalesce("place", F.lit(10**9)).alias("place"),
    )


def write_ai_zip(rows: DataFrame, path: str, company: str = "company", year: str = "year") -> int:
    """A zip of Company/Year.csv on the driver, streamed row by row in file order; returns the number of files."""
    import csv

    columns = [c for c in rows.columns if c not in (company, year)]
    files, now, buffer = 0, None, io.StringIO()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for r in rows.orderBy(company, year).toLocalIterator():
            name = f"{r[company]}/{r[year]}.csv"
            if name != now:
                if now:
                    out.writestr(now, buffer.getvalue())
                now, buffer, files = name, io.StringIO(), files + 1
                csv.writer(buffer).writerow(columns)
            csv.writer(buffer).writerow([r[c] for c in columns])
        if now:
            out.writestr(now, buffer.getvalue())
    return files


def experiment_rows(counts: DataFrame) -> DataFrame:
    """caught and missed by run (doc_id, version_id and alignment counters).

    ``missed`` follows the published definition, which adds unmatched cards to anchors; ``missed_anchors`` counts anchors alone.
    """
    human = F.col("anchors_with_human") + F.col("human_unmatched")
    caught = F.col("anchors_with_ai_and_human")
    return counts.withColumns({
        "human_total_anchors": human, "anchors_caught": caught, "anchors_missed": F.greatest(F.lit(0), human - caught),
        "missed_anchors": F.greatest(F.lit(0), F.col("anchors_with_human") - caught),
    })


def experiment_lines(rows: DataFrame) -> DataFrame:
    """doc_id, version_id, line: a markdown table row for each run; params as k=v."""
    cells = ["version_id", "workflow", "chunker", "params", "n_chunks", "ai_total", "anchors_caught", "anchors_missed"]
    text = rows.withColumn("params", params_text(F.col("chunker_params")))
    return text.select("doc_id", "version_id", F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells)), F.lit(" |")).alias("line"))


def top_index(counts: DataFrame) -> DataFrame:
    """Per document: its versions, the first version's ai_total, and the coders' totals."""
    return counts.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("version_id")), ", ").alias("versions"), F.min_by("ai_total", "version_id").alias("ai_total"),
        F.max("human_a_total").alias("human_a_total"), F.max("human_b_total").alias("human_b_total"),
    )


def new_runs(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    """Legacy runs to append to a versioned table: those it does not have."""
    return legacy.join(existing.select("doc_id", "version_id"), ["doc_id", "version_id"], "left_anti")
