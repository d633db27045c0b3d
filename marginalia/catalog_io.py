"""Registered queries over readers, writers, caches, prompts and small reports, as round trips of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import agreement, align, keywords, render, report
from .operators.sentences import sentence_arrays
from .plans import annotators, lifecycle, prompts, strategies
from .scratch import fresh_folder, write_file
from .sources import files, sinks
from .streaming import incremental


def _catalog():
    from . import catalog

    return catalog


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(df: DataFrame) -> DataFrame:
    return _catalog().plain(df)


def q_taxonomy_file(spark, sf_dir):
    """Written as CSV with quotes and line breaks, read by place; blank labels go."""
    rows = _table(spark, sf_dir, "nation").select(
        F.lit("Risk").alias("k"), F.concat("n_name", F.lit(" ; ")).alias("c"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("s"), "n_regionkey")).alias("s"),
        F.concat(F.lit('a "b",\n'), "n_name").alias("d"),
    )
    sinks.write_csv(rows, folder := fresh_folder(spark, "taxonomy"))
    return files.read_taxonomy(spark, folder)


def q_rubric_file(spark, sf_dir):
    rows = _table(spark, sf_dir, "region").select(F.concat(F.lit("Level "), F.col("r_regionkey"), F.lit(": x")).alias("a"), F.concat("r_name", F.lit(" ;")).alias("b"))
    sinks.write_csv(rows, folder := fresh_folder(spark, "rubric"))  # its header has no digit and goes
    return _plain(files.read_rubric(spark, folder))


def q_assumptions_file(spark, sf_dir):
    rows = _table(spark, sf_dir, "region").select(F.col("r_name").alias("What human coders were told"))
    sinks.write_csv(rows, folder := fresh_folder(spark, "assumptions"))
    return files.read_assumptions(spark, folder)


def q_keywords_file(spark, sf_dir):
    lines = _table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.when(F.col("n_nationkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("value"))
    found = files.read_keywords(spark, write_file(lines, fresh_folder(spark, "keywords") + "/words.txt"))
    return spark.createDataFrame(list(enumerate(found)), "place long, term string")


#: Customers in a section of the two-coder file; a section is a file, so that files stay of one size however many there are.
SECTION = 1000


def q_two_coder_file(spark, sf_dir):
    """Sections by nation and block of customers, each a file with its own header; a coder without a sentence has no row."""
    c = _table(spark, sf_dir, "customer").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("section", F.concat_ws("-", "n_nationkey", F.floor(F.col("c_custkey") / SECTION)))
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    a, b = F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 6 != 0
    cells = [F.lit("x"), F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise((2000 + F.col("c_custkey") % 5).cast("string")), F.lit("ai"), F.lit("Ann"),
             F.when(a, quoted(F.lit("said ""We"", "), "c_name", F.lit("\n2"))).otherwise(""), F.lit("Mitigation"), F.lit("IP"), F.concat((F.col("c_custkey") % 3).cast("string"), F.lit(".0")),
             F.when(b, quoted(F.lit("b "), "c_name")).otherwise(""), F.lit("risk"), F.lit("n/a")]
    head = "Company,10-K Year,AI_Term,Coder A Name,Coder A: Sentences Highlighted,Coder A: Risk or Mitigation?,Coder A: Subcategory,Coder A: Strength Annotation,Coder B: Sentences Highlighted,Coder B: Risk or Mitigation?,Coder B: Strength Annotation"
    body = c.select("section", F.lit(2).alias("o"), "c_custkey", F.concat_ws(",", *cells).alias("value"))
    top = lambda o, value: F.struct(F.lit(o).alias("o"), value.alias("value"))
    tops = c.select("section", "n_name").distinct().select("section", F.explode(F.array(top(0, F.concat("n_name", F.lit(",,,"))), top(1, F.lit(head)))).alias("t"))
    lines = tops.select("section", "t.o", F.lit(0).cast("long").alias("c_custkey"), "t.value").unionByName(body)
    dealt = lines.repartition("section").sortWithinPartitions("section", "o", "c_custkey").select("section", "value")
    dealt.write.partitionBy("section").text(folder := fresh_folder(spark, "coders"))
    names = {r.n_name: r.n_name.lower() for r in _table(spark, sf_dir, "nation").collect()}
    return files.read_two_coders(spark, folder, names)


def q_two_coder_rows(spark, sf_dir):
    return _plain(q_two_coder_file(spark, sf_dir).select("company", "company_display", "company_slug", "year", "ai_term", "coder", "coder_name", "sentence", "kind", "subcategory", "strength"))


def q_human_for_doc(spark, sf_dir):
    """The labels of the filing that comes first by company and year."""
    rows = q_two_coder_file(spark, sf_dir)
    first = rows.agg(F.min(F.struct("company_slug", "year")).alias("f")).first().f
    return _plain(files.human_for_doc(rows, first.company_slug, first.year).select("company", "year", "coder", "sentence"))


def q_group_sizes(spark, sf_dir):
    return _plain(files.group_sizes(q_two_coder_file(spark, sf_dir)))


def q_feedback_files(spark, sf_dir):
    """Two files with different headers, by header name."""
    n, folder = _table(spark, sf_dir, "nation"), fresh_folder(spark, "feedback")
    one = n.where("n_nationkey < 12").select(F.concat(F.lit("s-"), "n_nationkey").alias("anchor_id"), F.when(F.col("n_nationkey") % 3 != 0, "Human Miss").alias("decision"), F.col("n_name").alias("who"))
    two = n.where("n_nationkey >= 12").select(F.lit(" ok ").alias("decision"), F.col("n_name").alias("explanation"), F.concat(F.lit("s-"), "n_nationkey").alias("anchor_id"))
    sinks.write_csv(one.coalesce(1), f"{folder}/1")
    sinks.write_csv(two.coalesce(1), f"{folder}/2")
    rows = files.read_feedback(spark, [f"{folder}/1", f"{folder}/2"], {"who": "reviewer"})
    return rows.select("reviewer", "anchor_id", "decision", "explanation", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long").alias("place"))


def q_export_file(spark, sf_dir):
    """The annotation export: 40 text columns, typed on the way in."""
    o = _table(spark, sf_dir, "orders")
    own = {"cik": F.lpad(F.col("o_custkey").cast("string"), 10, "0"), "year": F.year("o_orderdate").cast("string"), "sentence_text": F.concat(F.lit('"q", '), "o_orderpriority"),
           "strength": F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 4).cast("string")), "disputed": (F.col("o_orderkey") % 2 == 0).cast("string"),
           "annotation_id": F.col("o_orderkey").cast("string"), "doc_id": F.lit("x")}
    sinks.write_csv(o.select(*(own.get(c, F.lit("")).alias(c) for c in files.EXPORT)), folder := fresh_folder(spark, "export"))
    return _plain(files.read_export(spark, folder).select("cik", "year", "sentence_text", "strength", "disputed", "annotation_id", "doc_id", "note", F.col("resolved_at").cast("string").alias("resolved_at")))


def q_json_records(spark, sf_dir):
    rows = _table(spark, sf_dir, "region").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("n"))))).alias("value"))
    return files.read_json_records(spark, write_file(rows, fresh_folder(spark, "json") + "/records.json"), "k long, n string")


def q_html_files(spark, sf_dir):
    """Every page as a file named company_year.htm; other names are left out."""
    name = F.when(F.col("page_id") % 4 == 3, F.format_string("notes%d.htm", "page_id")).otherwise(F.format_string("face_book_%d.htm", 2020 + F.col("page_id")))
    pages = _table(spark, sf_dir, "pages").select(name.alias("file"), F.col("html").alias("value"))
    dealt = pages.repartition(4 * spark.sparkContext.defaultParallelism, "file")  # tasks move their files to the folder; the driver would, one by one
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file").text(folder := fresh_folder(spark, "filings"))
    return files.extracted(files.read_html(spark, folder, {"face_book": "meta"}))


def _runs(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lower("n_name"), F.lit("_2024")).alias("doc_id"), F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("v2"), F.lit("v1"))).otherwise(F.array(F.lit("v1")))).alias("version_id"))


def q_registry(spark, sf_dir):
    """Filings with what there is about them: human labels, runs, versions."""
    n = _table(spark, sf_dir, "nation")
    filings = n.select(F.concat(F.lower("n_name"), F.lit("_2024")).alias("doc_id"), F.lower("n_name").alias("company"), F.lit(2024).alias("year"), F.lit("").alias("html"))
    human = n.where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("company_slug"), F.lit(2024).alias("year"))
    found = files.discover(filings, human, _runs(spark, sf_dir).where("doc_id like '%a%'"), [r.c for r in n.where("n_nationkey != 7").select(F.lower("n_name").alias("c")).collect()])
    return _plain(found.withColumn("versions", F.array_join("versions", ",")))


def q_versioned_table(spark, sf_dir):
    """A table by version; a version that is written again leaves the others alone."""
    rows, folder = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("v"), "n_regionkey").alias("version_id")), fresh_folder(spark, "versions")
    sinks.write_table(rows, folder, "t")
    sinks.write_table(rows.where("version_id = 'v1'").withColumn("k", -F.col("k")), folder, "t")
    return spark.read.parquet(f"{folder}/t").select("k", "version_id")


def q_run_meta(spark, sf_dir):
    """A row for each nation's document and strategy, written in two runs."""
    folder, presets = fresh_folder(spark, "meta"), strategies.STRATEGIES.values()
    own = lambda s: F.struct(F.lit(s.id).alias("version_id"), F.lit(s.label()).alias("display_label"), F.lit(s.model).alias("model"), F.lit(s.workflow).alias("workflow"),
                             F.lit(s.prompt).alias("prompt_builder"), F.lit(s.chunker).alias("chunker"),
                             F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(str(v))) for k, v in s.chunker_params.items())) if s.chunker_params else F.array().cast("array<struct<k:string,v:string>>")).alias("chunker_params"))
    rows = _runs(spark, sf_dir).select("doc_id").distinct().select("doc_id", F.explode(F.array(*(own(s) for s in presets))).alias("s")).select("doc_id", "s.*")
    counts = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    counts = counts.join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower("n_name"), F.lit("_2024")).alias("doc_id"), "n_chunks")
    for part in (F.col("doc_id") < "j", F.col("doc_id") >= "j"):
        sinks.append_meta(spark, folder, rows.join(counts, "doc_id", "left").where(part))
    found = spark.read.parquet(f"{folder}/run_meta")
    return _plain(found.select("doc_id", "version_id", "workflow", "chunker", T.params_text(F.col("chunker_params")).alias("params"), "n_chunks", F.col("created_at").isNotNull().alias("stamped")))


def q_latest(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    return files.latest(o, ["c"], "k")


def q_missing_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit("_2024")).alias("doc_id"))
    return lifecycle.missing(docs, _runs(spark, sf_dir), "v2")


def q_new_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return report.new_runs(runs, runs.where("version_id = 'v1' or doc_id like 'a%'"))


def q_new_content(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = d.where("doc_id % 3 != 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text")))
    return incremental.new_content(d, done.withColumn("content_hash", incremental.content_hash())).select("doc_id")


def q_cached_hits(spark, sf_dir):
    """Hits from the folder's table for this vocabulary; the second call reads what the first wrote."""
    words, s, folder = _catalog().VOCABULARY, _catalog().sentences(spark, sf_dir), fresh_folder(spark, "hits")
    keywords.cached_hits(s, words, folder)
    hits = keywords.cached_hits(s.where("false"), words, folder)
    return _plain(hits.select("doc_id", "sentence_idx", "anchor_id", F.array_join(F.array_sort("matched_terms"), ",").alias("terms")))


def q_stream_hits(spark, sf_dir):
    """The same hits from documents that arrive as a stream, written batch by batch."""
    source = f"{sf_dir}/documents.parquet"
    folder, landed = fresh_folder(spark, "stream"), fresh_folder(spark, "landed")
    spark.read.parquet(source).select("doc_id", "text").write.parquet(landed)
    stream = spark.readStream.schema("doc_id long, text string").parquet(landed)
    incremental.stream_hits(stream, _catalog().VOCABULARY, folder, fresh_folder(spark, "progress")).awaitTermination()
    return _plain(spark.read.parquet(folder).select("doc_id", "sentence_idx", "anchor_id", F.array_join(F.array_sort("matched_terms"), ",").alias("terms")))


def q_cached_replies(spark, sf_dir):
    """Replies kept by version and input; the second run asks for the new chunks only."""
    chunks = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("chunk_0000").alias("chunk_id"), "text")
    rules, folder = annotators.RuleAnnotator(_catalog().RULES), fresh_folder(spark, "replies")
    annotators.annotate_cached(rules, chunks.where("doc_id % 2 = 0"), "p", "v", folder)
    raw = annotators.annotate_cached(rules, chunks, "p", "v", folder)
    asked = spark.read.parquet(f"{folder}/replies").groupBy("doc_id").agg(F.count(F.lit(1)).alias("asked"))
    found = annotators.parse_reply(raw).select("doc_id", "status", F.size("answer.annotations").cast("long").alias("n"))
    return found.join(asked, "doc_id")


def q_numbered_lines(spark, sf_dir):
    return prompts.numbered(_catalog().sentences(spark, sf_dir))


def q_examples_block(spark, sf_dir):
    rows = _table(spark, sf_dir, "region").select(
        F.lit(0).alias("part"), F.col("r_regionkey").alias("rank"), F.lit("Human Miss").alias("decision"), F.lit("why").alias("explanation"), F.col("r_name").alias("sentence"), F.lit("long").alias("explanation_long"))
    return spark.createDataFrame([(prompts.examples_block(rows),)], "text string")


def q_schemas(spark, sf_dir):
    """The labels that phase schemas allow, of a taxonomy of regions and nations."""
    tax = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.when(F.col("n_nationkey") % 2 == 0, "Risk").otherwise("Risk Mitigation").alias("kind"), F.col("r_name").alias("category"), F.col("n_name").alias("subcategory"))
    rows = []
    for phase in prompts.PHASES:
        (listed,) = prompts.phase_schema(phase, tax)["properties"].values()
        for field, kind in listed["items"]["properties"].items():
            rows += [(phase, field, str(v)) for v in kind.get("enum", [])]
    return spark.createDataFrame(rows, "phase string, field string, value string")


def q_table_lines(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    grade = T.strength_text(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3).cast("int"))
    return o.select("o_orderkey", T.table_row(F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority"), F.col("o_custkey"), grade).alias("line"))


def q_experiment_lines(spark, sf_dir):
    counts = _catalog().run_counts(spark, sf_dir).withColumns({
        "workflow": F.lit("single"), "chunker": F.lit("n_sentence"), "chunker_params": F.create_map(F.lit("n_sentences"), F.lit("20")), "n_chunks": F.lit(3)})
    return report.experiment_lines(report.experiment_rows(counts))


def q_index_lines(spark, sf_dir):
    c = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"), (2000 + F.col("n_nationkey") % 2).alias("year"), F.lit("a").alias("accession"))
    return report.index_lines(report.split_index(c.unionByName(c.withColumn("year", F.col("year") + 5))))


def q_selected_rows(spark, sf_dir):
    rows = _catalog().q_annotation_rows(spark, sf_dir)
    return render.select_rows(rows, size=None, source=["AI"], type=["Risk"], category=[])


def q_page_of_rows(spark, sf_dir):
    """The third page of 10, of rows that one (place, source, coder) tells apart."""
    rows = _catalog().q_annotation_rows(spark, sf_dir).groupBy("place", "source", "coder").agg(F.count(F.lit(1)).alias("n"))
    return render.select_rows(rows, page=2, size=10)


def q_ordered_cards(spark, sf_dir):
    cards = _catalog().event_cards(spark, sf_dir)
    s = cards.where("anchor_id > 'h05'").select("doc_id", "anchor_id").distinct().withColumn("sentence_idx", F.substring("anchor_id", 2, 2).cast("int"))
    return _plain(render.ordered_cards(cards, s, "human").select("doc_id", "anchor_id", "sentence_excerpt", "place"))


def q_tag_rows(spark, sf_dir):
    labels = agreement.final_labels(_catalog().event_tags(spark, sf_dir), _catalog().event_resolutions(spark, sf_dir))
    each = labels.where("final_tags != ''").select("doc_id", "ordinal", F.explode(F.split("final_tags", "; ")).alias("final_tag"))
    return _plain(render.tag_rows(each))


def q_finalised_only(spark, sf_dir):
    labels = agreement.final_labels(_catalog().event_tags(spark, sf_dir), _catalog().event_resolutions(spark, sf_dir))
    return _plain(agreement.finalised_only(labels).select("doc_id", "ordinal", "adjudicated_status"))


def q_exact_duplicates(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("annotation_id"), "event_type", (F.col("user_id") % 7).alias("u"))
    return _plain(agreement.exact_duplicates(rows, ["event_type", "u"]))


def q_comments(spark, sf_dir):
    """Comments of a filing in one text, taken apart."""
    o = _table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Ann (10:00): see (x): "), "o_orderpriority", F.lit(" | Ben (2024-01-02): "), "o_orderstatus", F.lit(" | "))
    each = o.select("o_orderkey", F.explode(agreement.parse_comments(text)).alias("c"))
    return each.select("o_orderkey", "c.name", "c.time", "c.text")


def q_filing_people(spark, sf_dir):
    """Statuses of two or three annotators for each day, and its comments."""
    e = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("doc_id"), (F.col("user_id") % 3).alias("u"), "event_id")
    people = e.groupBy("doc_id", F.concat(F.lit("n"), "u").alias("annotator")).agg(F.count(F.lit(1)).alias("k"))
    statuses = people.select("doc_id", "annotator", F.when(F.col("k") % 2 == 0, "done").otherwise("in_progress").alias("status"), F.when(F.col("k") % 2 == 0, F.col("doc_id")).alias("done_at"))
    return agreement.filing_people(statuses, e.where("event_id % 40 = 0"))


#: Texts that are hard to cut, beside those of the tests; how many sentences each has stands in oracles_io.py.
SPLITTER_CASES = [
    ("colon header", "Any of these could:\n• cost us time."), ("lower-case continuation", "controls and strategies\nsupport our decisions"),
    ("prose", "We spent $7.4 billion, up 12.3%. Rules of the U.S. and the E.U. (e.g., the new act) cost us. See section 7.4.4 there. Few Ph.D. staff apply."),
    ("colon inside", "Note: the colon is inside. Here is another."), ("initials", "Mr. J. K. Smith left. He was cited."), ("quotes", "“Stop.” She left! Why? “No…” he said."),
    ("empty", ""), ("blank", " \n\t "), ("no end", "no end here"), ("many breaks", "A\n\n\nB\n \nC."),
]


def q_splitter_cases(spark, sf_dir):
    """Each case after a sentence with each nation's name, on a line of its own."""
    case = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in SPLITTER_CASES))).alias("c")
    docs = _table(spark, sf_dir, "nation").select("n_name", case).select(F.struct("n_name", "c.name").alias("k"), F.concat("n_name", F.lit(" came.\n"), "c.text").alias("text"))
    return sentence_arrays(docs, id_col="k").select(F.col("doc_id.n_name").alias("nation"), F.col("doc_id.name").alias("name"), F.size("sentences").cast("long").alias("n"))


def q_unresolved_cards(spark, sf_dir):
    rows = _catalog().lineitem_annotations(spark, sf_dir).where("kind != 'Other'").withColumn("subcategory", F.when(F.col("seq") == 2, "Other").otherwise(F.col("subcategory")))
    cards = align.resolve_category(rows.drop("category"), _catalog().small_taxonomy(spark)).withColumns({
        "side": F.lit("human"), "coder": F.lit("A"), "coder_name": F.lit("Ann"), "sentence_excerpt": F.concat("doc_id", F.lit("/"), "seq")})
    return align.unresolved_cards(cards).groupBy("kind", "subcategory").agg(F.count(F.lit(1)).alias("n"), F.min("sentence_excerpt").alias("first"))


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_") and name != "q_two_coder_file"}
