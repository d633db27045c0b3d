"""Readers of the engine's inputs.  Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import extract_html
from ..functions.text import clean_label, doc_slug, normalize_kind, to_strength
from ..scratch import holding, settled

TAXONOMY = "kind string, category string, subcategory string, description string"
HITS = "doc_id string, sentence_idx int, anchor_id string, matched_terms array<string>"
ANNOTATIONS = "doc_id string, version_id string, seq bigint, sentence string, kind string, category string, subcategory string, strength int, reasoning string"
PHASE_CACHE = "phase string, chunk_id string, raw_response string"
FEEDBACK = ("reviewer", "doc_slug", "source", "anchor_id", "sentence", "kind", "category", "subcategory", "strength", "decision", "explanation", "explanation_long")
# The 40 columns of the annotation export, and those that are no strings.
EXPORT = (
    "cik company year accession section_name sentence_ordinal sentence_text has_ai_keyword matched_keywords annotator_name kind category subcategory strength note "
    "status disputed pair_disputed group_id spans_n_sentences context_sentence_ordinals context_sentence_text adjudicated_status final_kind final_category "
    "final_subcategory final_strength final_tags doc_id annotation_id annotator_id resolved_to_none resolved_by resolved_at n_comments adjudication_comments "
    "strength_disputed filing_finalized adjudication_done_at archived"
).split()
EXPORT_TYPES = {
    **dict.fromkeys(("year", "strength", "spans_n_sentences", "final_strength", "n_comments"), "int"),
    **dict.fromkeys(("doc_id", "annotation_id", "annotator_id"), "bigint"),
    **dict.fromkeys(("has_ai_keyword", "disputed", "pair_disputed", "resolved_to_none", "strength_disputed", "filing_finalized", "archived"), "boolean"),
    **dict.fromkeys(("resolved_at", "adjudication_done_at"), "timestamp"),
}
# The header names of the two-coder file; its spelling is kept.
SHARED = {"year": "10-K Year", "ai_term": "AI_Term", "discrepancy_type": "Descripancy Type", "explanation": "Explanation"}
BY_CODER = {"coder_name": "Coder {} Name", "sentence": "Coder {}: Sentences Highlighted", "kind": "Coder {}: Risk or Mitigation?",
            "subcategory": "Coder {}: Subcategory", "strength": "Coder {}: Strength Annotation"}
FIRST_HEADER = "Company"


def _csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Quoted fields may hold line breaks; quotes are doubled; a header is matched by place."""
    return spark.read.schema(schema).options(header=header, multiLine=True, quote='"', escape='"', enforceSchema=True).csv(path)


def spread(rows: DataFrame) -> DataFrame:
    """Deal a table of few row groups over all cores before work that is heavy for each row; a large table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_html(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, company, year, html of ``<company>_<year>.htm`` files; other names are left out.

    A folder of that name, plain or as Spark writes partitions (``file=<name>``), may stand for the file that it holds.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    with holding(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks)):  # a task for each folder would take longer than the listing
        found = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = found.select(F.col("value").alias("html"), F.input_file_name().alias("path"))
    name = F.regexp_extract("path", r"/(?:[^/=]*=)?([^/=]+)\.html?(?:/[^/]*)?$", 1)
    company, year = doc_slug(name, aliases)
    return files.select(F.concat_ws("_", company, year.cast("string")).alias("doc_id"), company.alias("company"), year.alias("year"), "html").where("company is not null")


def extracted(filings: DataFrame) -> DataFrame:
    return filings.select("doc_id", extract_html(F.col("html")).alias("text"))


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary file, one term a line; blank lines go.  It is compiled into one pattern, so the driver holds it."""
    return [r.value for r in spark.read.text(path).select(F.trim("value").alias("value")).where("value != ''").collect()]


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Kind, category, subcategory, description by place; rows with a blank label go."""
    rows = _csv(spark, path, TAXONOMY).select(*(clean_label(F.col(c)).alias(c) for c in ("kind", "category", "subcategory", "description")))
    return rows.where("kind != '' and category != '' and subcategory != ''")


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """strength (the first digit of the first cell) and reason."""
    rows = _csv(spark, path, "level string, reason string", header=False)
    return rows.select(F.regexp_extract("level", "[0-9]", 0).try_cast("int").alias("strength"), clean_label(F.col("reason")).alias("reason")).where("strength is not null")


def read_assumptions(spark: SparkSession, path: str) -> DataFrame:
    """One assumption a row; a leading title row goes."""
    rows = _csv(spark, path, "assumption string", header=False).select(clean_label(F.col("assumption")).alias("assumption")).where("assumption != ''")
    return rows.where(~F.lower("assumption").startswith("what human coders"))


FULL, HEAD, TAIL = 0, 1, 2


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, cells (stripped) of the records of CSV files, in the order of (block, seq); large files are read block by block.

    Whether a block begins within quotes follows from the number of quotes before it, as a record has an even number of them (a quote
    sign belongs in quotes, doubled).  Records that blocks cut are put together from their pieces, one or two a block.
    """
    import csv
    import io

    import pandas as pd

    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    inside = parity.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"))  # a row for each block

    def cut(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for file, block, value, within in zip(batch["file"], batch["block"], batch["value"], batch["inside"]):
                if (file, block) != at:
                    if at and state[1]:
                        out.append((*at, state[2], HEAD if state[3] else TAIL, "\n".join(state[1])))
                    at, state = (file, block), [bool(within), [], 0, bool(within)]  # within quotes, lines so far, number, begun before
                state[1].append(value)
                state[0] ^= value.count('"') % 2 == 1
                if not state[0]:
                    out.append((*at, state[2], HEAD if state[3] else FULL, "\n".join(state[1])))
                    state[1], state[2], state[3] = [], state[2] + 1, False
            yield pd.DataFrame(out, columns=["file", "block", "seq", "piece", "text"])
        if at and state[1]:
            yield pd.DataFrame([(*at, state[2], HEAD if state[3] else TAIL, "\n".join(state[1]))], columns=["file", "block", "seq", "piece", "text"])

    def parse(batches):
        for batch in batches:
            cells = [[c.strip() for c in next(csv.reader(io.StringIO(t)), [])] for t in batch["text"]]
            yield batch[["file", "block", "seq"]].assign(cells=cells)

    pieces = settled(lines.join(F.broadcast(inside), ["file", "block"]).mapInPandas(cut, "file string, block long, seq long, piece int, text string"))
    order = Window.partitionBy("file").orderBy("block", "seq")
    parts = pieces.where(F.col("piece") != FULL).withColumn("n", F.sum((F.col("piece") == TAIL).cast("int")).over(order))
    own = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    joined = parts.groupBy("file", "n").agg(own.alias("p")).select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join("p.text", "\n").alias("text"))
    records = pieces.where(F.col("piece") == FULL).select("file", "block", "seq", "text").unionByName(joined)
    return records.mapInPandas(parse, "file string, block long, seq long, cells array<string>")


def read_two_coders(spark: SparkSession, path: str, companies: dict[str, str]) -> DataFrame:
    """The multi-section two-coder file in long form, a row for each coder that has a sentence.

    ``companies``: display name -> slug.  Sections start with a row that holds a known company alone, each has its own
    header row, and the company is the section's.  What section and header hold where a block of the file begins follows from the last
    ones of the blocks before it, so files of any size are read by many tasks.
    """
    known = {k.lower(): v for k, v in companies.items()}
    slugs = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.lit(None).cast("map<string,string>")
    first = F.get("cells", F.lit(0))
    alone = F.coalesce(F.element_at(slugs, F.lower(first)).isNotNull() & ~F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c != ""), F.lit(False))
    header = F.coalesce((first == FIRST_HEADER) & F.arrays_overlap("cells", F.array(F.lit(SHARED["year"]), F.lit(SHARED["ai_term"]))), F.lit(False)) & ~alone
    spot = F.struct("block", "seq")
    rows = csv_records(spark, path).withColumn("mark", F.when(alone, F.struct(spot.alias("at"), first.alias("company")))).withColumn("head", F.when(header, F.struct(spot.alias("at"), F.col("cells").alias("names"))))
    rows = settled(rows)
    ends = rows.groupBy("file", "block").agg(F.max("mark").alias("m"), F.max("head").alias("h"))  # the last of a block: its place is greatest
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.max("m").over(before).alias("mark0"), F.max("h").over(before).alias("head0"))
    sofar = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mark1", F.max("mark").over(sofar)).withColumn("head1", F.max("head").over(sofar))
    rows = rows.where("mark is null and head is null").join(F.broadcast(ends), ["file", "block"])
    rows = rows.withColumn("mark", F.coalesce("mark1", "mark0")).withColumn("head", F.coalesce("head1", "head0")).where("mark.at < head.at")
    get = lambda name: F.coalesce(F.get("cells", (F.size("head.names") - F.array_position(F.reverse("head.names"), F.lit(name))).cast("int")), F.lit(""))
    named = lambda name: F.when(F.array_contains("head.names", F.lit(name)), get(name)).otherwise("")
    shared = [named(v).alias(k) for k, v in SHARED.items()]
    coder = lambda c: F.struct(F.lit(c).alias("coder"), *(named(v.format(c)).alias(k) for k, v in BY_CODER.items()))
    each = rows.select(F.col("mark.company").alias("company"), "block", "seq", *shared, F.explode(F.array(coder("A"), coder("B"))).alias("c")).where("c.sentence != '' and year rlike '^[0-9]+$'")
    return each.select(
        "company", F.col("company").alias("company_display"), F.element_at(slugs, F.lower("company")).alias("company_slug"), F.col("year").cast("int").alias("year"), "ai_term", "c.coder", "c.coder_name", "c.sentence",
        normalize_kind(F.col("c.kind")).alias("kind"), "c.subcategory", to_strength(F.col("c.strength")).alias("strength"), "discrepancy_type", "explanation",
        (2 * (F.col("block") + F.col("seq")) + (F.col("c.coder") == "B").cast("int")).alias("seq"),  # a block has no more records than signs
    )


def human_for_doc(rows: DataFrame, company_slug: str, year: int) -> DataFrame:
    return rows.where((F.col("company_slug") == company_slug) & (F.col("year") == year))


def group_sizes(rows: DataFrame) -> DataFrame:
    """How many records each company, year and coder has."""
    return rows.groupBy("company_slug", "year", "coder").agg(F.count(F.lit(1)).alias("n"))


def read_feedback(spark: SparkSession, paths: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Reviewer feedback from files with different headers, by header name; rows without an anchor or decision go.

    ``renames``: header -> column, where a file calls a column otherwise.
    """
    out = None
    for number, path in enumerate(paths):  # a file with line breaks in its fields is read by one task, so places follow the file
        rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=False).csv(path)
        place = F.lit(number << 40) + F.monotonically_increasing_id()
        for old, new in (renames or {}).items():
            if old in rows.columns:
                rows = rows.withColumnRenamed(old, new)
        rows = rows.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns if c in FEEDBACK), place.alias("seq"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    for c in FEEDBACK:
        out = out.withColumn(c, F.coalesce(F.col(c) if c in out.columns else F.lit(None), F.lit("")))
    return out.where("anchor_id != '' and decision != ''").select(*FEEDBACK, "seq")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The annotation tool's export with typed columns; blanks are null, cik stays text."""
    rows = _csv(spark, path, ", ".join(f"{c} string" for c in EXPORT))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(*((blank(c).try_cast(EXPORT_TYPES[c]) if c in EXPORT_TYPES else blank(c)).alias(c) for c in EXPORT))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of records in a JSON file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def available_versions(aligned: DataFrame) -> DataFrame:
    """doc_id, versions (sorted)."""
    return aligned.groupBy("doc_id").agg(F.array_sort(F.collect_set("version_id")).alias("versions"))


def discover(filings: DataFrame, human: DataFrame, aligned: DataFrame, companies: list[str] | None = None) -> DataFrame:
    """The registry: filings with has_human, has_ai and versions; only listed companies, if any are."""
    if companies:
        filings = filings.where(F.col("company").isin(companies))
    people = human.select(F.col("company_slug").alias("company"), "year").distinct().withColumn("_h", F.lit(True))
    rows = filings.drop("html").join(people, ["company", "year"], "left").join(available_versions(aligned), "doc_id", "left")
    return rows.select(
        "doc_id", "company", "year", F.coalesce("_h", F.lit(False)).alias("has_human"), F.col("versions").isNotNull().alias("has_ai"),
        F.coalesce("versions", F.array().cast("array<string>")).alias("versions"),
    )


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
