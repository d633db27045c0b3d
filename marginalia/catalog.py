"""The registered queries over the driver's tables, and their DuckDB SQL (in oracles.py).

The tables hold no annotations, so deterministic stand-ins take their place, defined alike on both sides:

* cards from ``events``: a document is a day, an anchor an hour, the side ``user_id % 3`` (machine, coder A, coder B), a
  category the event type, mitigations are purchase and signup with strength ``1 + event_id % 3``; every 17th event's card
  matches no anchor;
* tool tags from ``events``: annotators are ``user_id % 2``, every fifth tag spans two sentences;
* verdicts of phases from the sentences of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_io
from .functions import text as T
from .functions.arrays import sorted_join
from .functions.html import extract_html
from .operators import agreement, align, annotations, chunks, diagnose, evaluate, feedback, keywords, phases, render, report
from .operators.sentences import build_index, sentence_arrays
from .plans import lifecycle
from .plans.annotators import PhaseRules, RuleAnnotator, annotations_of, parse_reply, reply_items
from .plans.strategies import Strategy, get_strategy
from .scratch import settled
from .sources.files import spread

VOCABULARY = ["the", "tion", "ment", "schaft", "ciones"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
MITIGATING = ["purchase", "signup"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles to six places: the same in any engine."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint"}
    cols = [F.col(c).cast(kinds[k]).alias(c) if k in kinds else F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    return df.select(*cols)


# --- stand-ins -------------------------------------------------------------------------------------------------


def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    side, mit, none = F.col("user_id") % 3, F.col("event_type").isin(MITIGATING), F.lit(None).cast("string")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("doc_id"),
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("h"), F.date_format("ts", "HH"))).alias("anchor_id"),
        F.when(side == 0, "ai").otherwise("human").alias("side"),
        F.when(side == 1, "A").when(side == 2, "B").alias("coder"),
        F.when(side == 1, "Ann").when(side == 2, "Ben").alias("coder_name"),
        F.when(mit, "Risk Mitigation").otherwise("Risk").alias("kind"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("sub"), F.col("event_id") % 4).alias("subcategory"),
        F.when(mit, 1 + F.col("event_id") % 3).cast("int").alias("strength"),
        F.concat(F.lit("event "), "event_id").alias("sentence_excerpt"),
        none.alias("reasoning"),
    )


def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("category")).distinct()


def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour, mit = F.hour("ts"), F.col("event_type").isin(MITIGATING)
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("doc_id"), F.col("event_id").alias("annotation_id"),
        F.concat(F.lit("ann"), F.col("user_id") % 2).alias("annotator"), F.lit(None).cast("string").alias("group_id"),
        F.when(F.col("event_id") % 5 == 0, F.array(hour, hour + 1)).otherwise(F.array(hour)).alias("ordinals"),
        F.when(mit, "Mitigation").otherwise("Risk").alias("kind"), F.col("event_type").alias("category"), F.lit("-").alias("subcategory"),
        F.when(mit, 1 + F.col("event_id") % 3).cast("int").alias("strength"),
    )


def event_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agreement.per_sentence(event_tags(spark, sf_dir)).select("doc_id", "ordinal").distinct().where("ordinal % 4 = 0")
    return rows.select("doc_id", "ordinal", F.when(F.col("ordinal") % 8 == 0, "").otherwise("Risk · view · -; Mitigation · signup · - · S2").alias("final_tags"), (F.col("ordinal") % 12 == 0).alias("is_span"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(spread(table(spark, sf_dir, "documents")))


def phase_verdicts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-in verdicts; they hang on a text's length and letters, so that no text goes into them."""
    has = lambda w: F.col("text").contains(w)
    found = sentences(spark, sf_dir).select("doc_id", "sentence_idx", "anchor_id", F.length("text").alias("n"), (has("th") | has("en")).alias("candidate"), has("on").alias("mention"))
    s = settled(found.repartition("doc_id", "anchor_id"))  # what most joins are on
    seq = F.col("sentence_idx").alias("seq")
    base = ["doc_id", "anchor_id", seq]
    return {
        "sentences": s,
        "candidates": s.where("candidate").select(*base),
        "mentions": s.where("mention").select(*base),
        "passages": s.where(F.col("sentence_idx") % 7 == 0).select(
            "doc_id", F.col("sentence_idx").alias("passage"), F.format_string("s-%05d", F.col("sentence_idx") + 2).alias("start_anchor"),
            F.col("anchor_id").alias("end_anchor"), F.concat(F.lit("topic "), "sentence_idx").alias("topic_summary")),
        "context": s.where(F.col("n") % 5 != 0).select(*base, (F.col("n") % 3 != 0).alias("keep"), F.concat(F.lit(" length "), "n").alias("reason")),
        "kinds": s.where(F.col("n") % 11 != 0).select(*base, F.when(F.col("n") % 4 == 0, "Risk Mitigation").when(F.col("n") % 4 == 3, "Neither").otherwise("Risk").alias("kind")),
        "risk_cats": s.where(F.col("n") % 13 != 0).select(*base, F.lit("Legal").alias("category"), F.concat(F.lit("r"), F.col("n") % 3).alias("subcategory")),
        "mit_cats": s.where(F.col("n") % 13 != 1).select(*base, F.lit("Governance").alias("category"), F.concat(F.lit("m"), F.col("n") % 2).alias("subcategory")),
        "strengths": s.where(F.col("n") % 6 != 0).select(*base, (1 + F.col("n") % 3).cast("int").alias("strength")),
    }


# --- text ------------------------------------------------------------------------------------------------------


def q_html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract_html(F.col("html")).alias("text"))


#: Hand-written pages; what is to come out of them stands in oracles.py.
HTML_CASES = [
    ("attributes", '<div data-x="a>b" class=\'hidden-not\'>kept</div><p HIDDEN>gone</p><p>end</p>'),
    ("aria", '<span aria-hidden="true">gone</span><b aria-hidden="false">kept</b>'),
    ("breaks", "<p>Three<br>Four<br/>five</p>"),
    ("broken line", "<p>word,\nlower and\nUpper</p>"),
    ("cell", "<ul><li>one<li style='display:none'>gone<li>two</ul>"),
    ("comment", "a<!-- <p>x</p> -- > y -->b<!---->c"),
    ("entities", "<p>&#8217;tis &#x201C;so&#x201D; &eacute;t&eacute; &amp;lt; &lt;b&gt; AT&T R&ampD &hellip; &nosuch;</p>"),
    ("hidden deep", '<div style="Display : None"><div>in</div>still in</div><div>out</div>'),
    ("hidden table cell", "<section><td hidden>gone</td>kept</section>"),
    ("ix", "<ix:header><ix:hidden><ix:nonnumeric>gone</ix:nonnumeric></ix:hidden></ix:header><ix:nonfraction>7</ix:nonfraction> kept"),
    ("less than", "<p>a < b and c > d</p>"),
    ("links", '<p>See <a href="http://x.y/z">https://x.y/z?a=1</a> now</p>'),
    ("nested table", "<p>a</p><table><tr><td><table><tr><td>x</td></tr></table>tail</td></tr></table><p>b</p>"),
    ("no html", "plain text"),
    ("page numbers", "<p>one</p><p> 12 </p><p>two</p>"),
    ("paragraphs without end", "<p>one<p style='visibility: hidden'>gone<p>two<div>three"),
    ("scripts", "<script>var a='</p><p>x';</script><style>p{}</style><noscript>x</noscript>y"),
    ("spaces", "<p>a&nbsp;&nbsp;b\u200bc\t\td  \n  e</p>"),
    ("truncated", "<p>one &amp two</p><a href=\"http://x"),
    ("buttons", "<form><input name=a>x</form><button>y</button><select><option>z</select>kept<svg><text>s</text></svg><figure>f</figure>"),
]


def q_html_cases(spark, sf_dir):
    """What regular expressions would misread: nested and hidden elements, any entity, tags without an end; after each nation's name."""
    case = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(html).alias("html")) for name, html in HTML_CASES))).alias("c")
    rows = table(spark, sf_dir, "nation").select("n_name", case)
    return rows.select(F.col("n_name").alias("nation"), "c.name", extract_html(F.concat(F.lit("<p>"), "n_name", F.lit(".</p><br>"), "c.html")).alias("text"))


def q_html_nested(spark, sf_dir):
    """Every page after nested tables, with hidden elements in each paragraph, and with numeric entities."""
    html = F.col("html")
    for old, new in (("&amp;", "&#38;"), ("&nbsp;", "&#xA0;"), ("<p>", "<p><u style='color: red; DISPLAY : none'>in<u>deeper</u>still in</u>"), ("</p>", "<i hidden>a<b>b</b>c</i>&#8217;<s aria-hidden=\"true\">d</s></p>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    head = "<table><tr><td title='a > b'><table><tr><td>x</table>y<td>z</table><!-- <p>no</p> --><section hidden><p>one<section>two</section>three</section>"
    return table(spark, sf_dir, "pages").select("page_id", extract_html(F.concat(F.lit(head), html)).alias("text"))


def q_normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize_text(F.col("text")).alias("text"), T.match_key(F.col("text")).alias("key"), T.excerpt(T.normalize_text(F.col("text"))).alias("excerpt"))


def q_labels_clean(spark, sf_dir):
    """Label, strength and path functions on orders' and customers' text columns."""
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit(" "), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lit("; Other; ")).when(F.col("c_custkey") % 3 == 1, F.lit(": Legal")).otherwise(F.lit(" ;")))
    has, head, tail = T.split_label(raw)
    strength = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), (F.col("c_custkey") % 5).cast("string"), F.lit(".7")))
    return plain(c.select(
        "c_custkey", T.clean_label(raw).alias("label"), has.alias("has_parts"), head.alias("head"), tail.alias("tail"), T.to_strength(strength).alias("strength"),
        T.path_token(F.concat(F.lit(" ./"), "c_name", F.lit(": a?b "))).alias("token"), T.normalize_kind(F.when(F.col("c_custkey") % 2 == 0, " MITIGATION ").otherwise("risk")).alias("kind"),
    ))


def q_sentence_index(spark, sf_dir):
    return plain(sentences(spark, sf_dir))


def q_keyword_hits(spark, sf_dir):
    hits = keywords.find_hits(sentences(spark, sf_dir), VOCABULARY)
    return plain(hits.select("doc_id", "sentence_idx", "anchor_id", F.array_join(F.array_sort("matched_terms"), ",").alias("terms")))


def q_keyword_hits_large(spark, sf_dir):
    """Hits of a large vocabulary: every word of seven letters or more that the conversations hold."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("w")).distinct()
    hits = keywords.find_hits(sentences(spark, sf_dir), [r.w for r in words.collect()])
    return plain(hits.select("doc_id", "sentence_idx", F.lower(F.get("matched_terms", F.lit(0))).alias("first"), F.size("matched_terms").alias("_n")).drop("_n"))


def q_coverage(spark, sf_dir):
    """The flagship: documents to sentences, hits, merged keyword windows and a summary per document."""
    return plain(lifecycle.coverage(spread(table(spark, sf_dir, "documents")), VOCABULARY, 2))


# --- chunks ----------------------------------------------------------------------------------------------------


def _ranges(name, with_hits=False, **params):
    def query(spark, sf_dir):
        s = settled(sentences(spark, sf_dir).select("doc_id", "sentence_idx", "anchor_id", "text")) if with_hits else sentences(spark, sf_dir)
        hits = keywords.find_hits(s, ["ment", "ciones"]) if with_hits else None
        return plain(chunks.chunk_ranges(name, s, hits, **params).select("doc_id", "chunk", "lo", "hi"))

    return query


def q_chunk_texts(spark, sf_dir):
    arrays = sentence_arrays(spread(table(spark, sf_dir, "documents")))
    texts = chunks.chunk_rows(arrays, "n_sentence", n_sentences=5, stride=3)
    return plain(texts.select("doc_id", "chunk_id", "lo", "hi", F.array_join("sentence_indices", ",").alias("indices"), "first_anchor", "last_anchor", "text"))


def q_chunk_texts_joined(spark, sf_dir):
    """The same chunks by rows: ranges joined to sentences."""
    s = settled(sentences(spark, sf_dir))
    texts = chunks.chunk_texts(chunks.n_sentence(s, n_sentences=5, stride=3), s)
    return plain(texts.select("doc_id", "chunk_id", "lo", "hi", F.array_join("sentence_indices", ",").alias("indices"), "first_anchor", "last_anchor", "text"))


def _row_ranges(name, **params):
    """A chunker's ranges from arrays; the SQL is that of the chunker by rows."""

    def query(spark, sf_dir):
        arrays = sentence_arrays(spread(table(spark, sf_dir, "documents")))
        found = chunks.chunk_arrays(arrays, name, ["ment", "ciones"], **params)
        return plain(found.select("doc_id", F.posexplode("_r").alias("chunk", "r")).select("doc_id", "chunk", "r.lo", "r.hi"))

    return query


def q_context_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.withColumn("line", F.concat("role", F.lit(": "), "text"))
    return plain(chunks.context_window(rows, "conv_id", "turn", "line", 2, 2).select("conv_id", "turn", "context"))


def q_passage_members(spark, sf_dir):
    v = phase_verdicts(spark, sf_dir)
    return plain(chunks.passage_members(v["passages"], v["sentences"]))


# --- annotations and alignment -----------------------------------------------------------------------------------


def q_dedupe_first(spark, sf_dir):
    s = sentences(spark, sf_dir)
    rows = s.select(F.lit("all").alias("doc_id"), (F.col("doc_id") * 1000000 + F.col("sentence_idx")).alias("seq"), F.col("text").alias("sentence"), F.lit("Risk").alias("kind"),
                    F.concat(F.lit("c"), F.length("text") % 3).alias("category"), F.lit(None).cast("string").alias("subcategory"), F.lit(None).cast("int").alias("strength"))
    return annotations.dedupe_annotations(rows).select("seq", "category")


def lineitem_annotations(spark, sf_dir):
    """Labels from lineitem: some kinds, categories, subcategories and strengths are none of the taxonomy's."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "Risk").when(F.col("l_returnflag") == "A", "Risk Mitigation").otherwise("Other").alias("kind"),
        F.when(F.col("l_partkey") % 5 == 0, "odd").otherwise(F.concat(F.lit("c"), F.col("l_partkey") % 2)).alias("category"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("subcategory"), F.when(F.col("l_suppkey") % 6 != 0, F.col("l_suppkey") % 5).cast("int").alias("strength"),
    )


def small_taxonomy(spark):
    rows = [("Risk", "c0", "s0"), ("Risk", "c1", "s1"), ("Risk Mitigation", "c1", "s1"), ("Risk Mitigation", "c1", "s2"), ("Risk", "c1", "other"), ("Risk", "c0", "other")]
    return spark.createDataFrame(rows, "kind string, category string, subcategory string")


def q_validate_reasons(spark, sf_dir):
    return annotations.validate_annotations(lineitem_annotations(spark, sf_dir), small_taxonomy(spark))[1]


def q_validate_kept(spark, sf_dir):
    valid, _ = annotations.validate_annotations(lineitem_annotations(spark, sf_dir), small_taxonomy(spark))
    return plain(valid.groupBy("kind", "category", "subcategory", "strength").agg(F.count(F.lit(1)).alias("n")))


def q_resolve_category(spark, sf_dir):
    rows = lineitem_annotations(spark, sf_dir).withColumn("subcategory", F.when(F.col("seq") == 1, "Legal; x").when(F.col("seq") == 2, "Other").when(F.col("seq") == 3, "a: b ;").otherwise(F.upper("subcategory")))
    found = align.resolve_category(rows.drop("category"), small_taxonomy(spark))
    return found.groupBy("kind", "category", "subcategory").agg(F.count(F.lit(1)).alias("n"))


def sentence_queries(spark, sf_dir):
    """An annotation for each sentence: in capitals with curly quotes, or with another tail, or without its first letters."""
    s, n = settled(sentences(spark, sf_dir)), F.col("sentence_idx") % 3
    text = F.when(n == 0, F.concat(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("  "))).when(n == 1, F.concat(F.substring("text", 1, 100), F.lit(" qq"))).otherwise(F.expr("substring(text, 5)"))
    return s, s.select("doc_id", "sentence_idx", text.alias("sentence"))


def q_align_cascade(spark, sf_dir):
    s, q = sentence_queries(spark, sf_dir)
    found = align.find_anchors(q.select("doc_id", "sentence"), s)
    return plain(found.select("doc_id", "key", "sentence_idx", "stage", "anchor_id"))


def q_align_cards(spark, sf_dir):
    """The whole alignment: machine labels and two coders' labels on the sentences, as counts by document."""
    s, q = sentence_queries(spark, sf_dir)
    n = F.col("sentence_idx")
    ai = q.where(n % 2 == 0).select("doc_id", "sentence", F.lit("Risk").alias("kind"), F.lit("c1").alias("category"), F.lit("s1").alias("subcategory"), F.lit(None).cast("int").alias("strength"))
    human = q.where(n % 4 != 3).select("doc_id", F.when(n % 4 == 0, "A").otherwise("B").alias("coder"), F.lit("x").alias("coder_name"), "sentence",
                                       F.when(n % 5 != 0, "Risk").otherwise("").alias("kind"), F.when(n % 3 == 0, "other").otherwise("s1").alias("subcategory"), F.lit(None).cast("int").alias("strength"))
    return plain(align.align_counts(align.align(s, ai, human, small_taxonomy(spark)), human))


# --- evaluation ------------------------------------------------------------------------------------------------


def q_anchor_sources(spark, sf_dir):
    return align.anchor_sources(event_cards(spark, sf_dir)).select("doc_id", "anchor_id", "source")


def q_align_counts(spark, sf_dir):
    return plain(align.align_counts(event_cards(spark, sf_dir)))


def frame(spark, sf_dir, mode="union"):
    return evaluate.label_frame(event_cards(spark, sf_dir), mode=mode)


def _label_frame(mode):
    def query(spark, sf_dir):
        f = frame(spark, sf_dir, mode).where("anchor_id not like 'unmatched%'")
        sets = [F.expr(sorted_join(c)).alias(c) for c in f.columns if c.split("_")[-1] in ("categories", "kinds", "subcats")]
        return plain(f.select("doc_id", "anchor_id", *sets, "ai_strength_max", "human_strength_max"))

    return query


def _label_frame_unmatched(mode):
    def query(spark, sf_dir):
        """The rest of the frame: a row for each card that matches no anchor, numbered by side in the order of excerpts."""
        f = frame(spark, sf_dir, mode).where("anchor_id like 'unmatched%'")
        sets = [F.expr(sorted_join(c)).alias(c) for c in f.columns if c.split("_")[-1] in ("categories", "kinds", "subcats")]
        return plain(f.select("doc_id", "anchor_id", "sentence_text", *sets, "ai_strength_max", "human_strength_max"))

    return query


def q_comparison_unmatched(spark, sf_dir):
    return plain(evaluate.comparison_table(frame(spark, sf_dir).where("anchor_id like 'unmatched%'")).drop("sentence"))


def q_frame_rows(spark, sf_dir):
    """Rows of the frame by mode, matched or not: what a filter removes and what it leaves empty."""
    out = None
    for mode in evaluate.FILTERS:
        f = frame(spark, sf_dir, mode)
        part = f.groupBy(F.lit(mode).alias("mode"), F.substring_index("anchor_id", "_", 2).rlike("^unmatched").alias("unmatched")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.size("human_categories") == 0).alias("without_human"), F.sum(F.size("ai_categories")).alias("ai_labels"))
        out = part if out is None else out.unionByName(part)
    return out


def q_prf_per_category(spark, sf_dir):
    return plain(evaluate.per_category(frame(spark, sf_dir), event_categories(spark, sf_dir)))


def q_prf_averages(spark, sf_dir):
    return plain(evaluate.averages(evaluate.per_category(frame(spark, sf_dir), event_categories(spark, sf_dir))))


def q_prf_displayed(spark, sf_dir):
    return plain(evaluate.displayed(evaluate.per_category(frame(spark, sf_dir, "coder_a"), event_categories(spark, sf_dir))))


def q_kappa(spark, sf_dir):
    return plain(evaluate.coder_agreement(event_cards(spark, sf_dir), event_categories(spark, sf_dir)))


def q_confusion_category(spark, sf_dir):
    return plain(evaluate.category_confusion(frame(spark, sf_dir), EVENT_TYPES))


def q_confusion_strength(spark, sf_dir):
    return plain(evaluate.strength_confusion(frame(spark, sf_dir)))


def q_confusion_headlines(spark, sf_dir):
    return plain(evaluate.confusion_headlines(evaluate.category_confusion(frame(spark, sf_dir), EVENT_TYPES)))


def q_strength_headline(spark, sf_dir):
    return plain(evaluate.strength_headline(evaluate.strength_confusion(frame(spark, sf_dir))))


def q_strength_levels(spark, sf_dir):
    f = evaluate.strength_levels(frame(spark, sf_dir))
    return f.select(F.array_join("ai", ",").alias("ai"), F.array_join("human", ",").alias("human"))


def q_fp_counts(spark, sf_dir):
    return evaluate.false_positives(frame(spark, sf_dir))


def q_comparison(spark, sf_dir):
    return plain(evaluate.comparison_table(frame(spark, sf_dir).where("anchor_id not like 'unmatched%'")).drop("sentence"))


def q_labels_prf(spark, sf_dir):
    """A rule (long documents are good) against the quality labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    one = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    f = rows.select("doc_id", F.lit("d").alias("anchor_id"), one(F.col("quality") == 1, "good").alias("human_categories"), one(F.col("n_chars") > 500, "good").alias("ai_categories"))
    return plain(evaluate.per_category(f, spark.createDataFrame([("good",)], "category string")))


# --- agreement -------------------------------------------------------------------------------------------------


def q_sentence_disputes(spark, sf_dir):
    return plain(agreement.sentence_disputes(event_tags(spark, sf_dir)))


def q_tag_disputes(spark, sf_dir):
    return plain(agreement.tag_disputes(event_tags(spark, sf_dir)))


def q_final_labels(spark, sf_dir):
    return plain(agreement.final_labels(event_tags(spark, sf_dir), event_resolutions(spark, sf_dir)))


def q_final_parts(spark, sf_dir):
    rows = agreement.final_labels(event_tags(spark, sf_dir), event_resolutions(spark, sf_dir)).where("adjudicated_status = 'resolved'")
    return plain(rows.select("doc_id", "ordinal", *(c.alias(n) for n, c in agreement.final_parts(F.col("final_tags")).items())))


def q_filing_summary(spark, sf_dir):
    return plain(agreement.filing_summary(agreement.final_labels(event_tags(spark, sf_dir), event_resolutions(spark, sf_dir))).drop("n_pairs"))


def q_adjudication_report(spark, sf_dir):
    return plain(agreement.adjudication_report(agreement.final_labels(event_tags(spark, sf_dir), event_resolutions(spark, sf_dir))))


def q_span_collapse(spark, sf_dir):
    rows = agreement.per_sentence(event_tags(spark, sf_dir))
    members = rows.select("doc_id", "annotator", "kind", "category", "subcategory", "annotation_id", "ordinal", F.concat(F.col("category"), F.lit(" on "), "doc_id", F.lit(" h"), "annotator").alias("group_id"),
                          F.concat(F.lit("text "), "ordinal").alias("sentence_text"), F.array(F.concat(F.lit("k"), F.col("annotation_id") % 3)).alias("keywords"))
    return plain(agreement.collapse_spans(members).drop("annotation_id"))


def q_coder_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd").alias("doc_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("coder"), F.concat(F.lit("n"), F.col("user_id") % 7).alias("coder_name"), F.col("event_id").alias("seq"))
    return agreement.coder_names(rows)


# --- phases, feedback, reports -------------------------------------------------------------------------------------


def q_sequential(spark, sf_dir):
    v = phase_verdicts(spark, sf_dir)
    return plain(phases.sequential(v["sentences"], v["candidates"], v["kinds"], v["risk_cats"], v["mit_cats"], v["strengths"]).drop("sentence"))


def q_passage_aware(spark, sf_dir):
    v = phase_verdicts(spark, sf_dir)
    found = phases.passage_aware(v["sentences"], v["passages"], v["mentions"], v["context"], v["kinds"], v["risk_cats"], v["mit_cats"], v["strengths"])
    return plain(found.drop("sentence"))


def _missed(v):
    return v["sentences"].where("sentence_idx % 2 = 0").select("doc_id", "anchor_id")


def q_diagnosis_passages(spark, sf_dir):
    v = phase_verdicts(spark, sf_dir)
    return diagnose.diagnose_passages(_missed(v), v["sentences"], v["passages"], v["mentions"], v["context"], v["kinds"], v["risk_cats"], v["mit_cats"])


def q_diagnosis_phases(spark, sf_dir):
    v = phase_verdicts(spark, sf_dir)
    return diagnose.diagnose_phases(_missed(v), v["candidates"], v["kinds"], v["risk_cats"], v["mit_cats"])


def q_loss_buckets(spark, sf_dir):
    return diagnose.loss_buckets(q_diagnosis_passages(spark, sf_dir), event_cards(spark, sf_dir))


def q_missed_anchors(spark, sf_dir):
    return diagnose.missed_anchors(event_cards(spark, sf_dir))


def q_few_shot(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        "doc_id", F.col("doc_id").alias("seq"), F.col("source").alias("doc_slug"), F.col("lang").alias("anchor_id"), F.lit("Risk").alias("kind"), F.col("source").alias("explanation"),
        (F.col("n_chars") % 50).cast("string").alias("category"), F.lit("-").alias("subcategory"), F.col("text").alias("explanation_long"),
        F.when(F.col("doc_id") % 3 == 0, "Human Miss").otherwise("AI-flagged incorrectly").alias("decision"),
    )
    return plain(feedback.few_shot_examples(rows).select("doc_id", "part", "rank", "decision", "explanation"))


def q_annotation_rows(spark, sf_dir):
    cards = event_cards(spark, sf_dir)
    s = cards.where("anchor_id is not null").select("doc_id", "anchor_id").distinct().select("doc_id", "anchor_id", F.substring("anchor_id", 2, 2).cast("int").alias("sentence_idx"), F.concat(F.lit("text "), "anchor_id").alias("text"))
    return plain(render.annotation_rows(cards, s))


def q_paragraph_tokens(spark, sf_dir):
    """Single line breaks part paragraphs here, as the documents hold no blank lines."""
    d = spread(table(spark, sf_dir, "documents"))
    return plain(render.paragraph_tokens(d, separator="\\n").drop("source_class"))


def q_paragraph_tokens_joined(spark, sf_dir):
    """The same tokens from sentences by row, with the classes of the events' sources (an anchor's source hangs on its number)."""
    d, s = table(spark, sf_dir, "documents"), sentences(spark, sf_dir)
    kind = F.element_at(F.array(*(F.lit(k) for k in render.SOURCE_CLASS)), (F.col("sentence_idx") % len(render.SOURCE_CLASS) + 1).cast("int"))
    sources = s.where("sentence_idx % 3 != 0").select("doc_id", "anchor_id", kind.alias("source"))
    return plain(render.paragraph_tokens(d, s.drop("text"), sources, separator="\\n"))


def q_split_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("n_name").alias("company"), (2000 + F.col("c_custkey") % 4).alias("year"), F.concat(F.lit("acc/"), (F.col("c_custkey") % 8 == 1).cast("string")).alias("accession"))
    return report.split_index(rows).drop("label")


def run_counts(spark, sf_dir):
    return align.align_counts(event_cards(spark, sf_dir)).withColumn("version_id", F.lit("baseline"))


def q_experiment_log(spark, sf_dir):
    rows = report.experiment_rows(run_counts(spark, sf_dir))
    return plain(rows.select("doc_id", "version_id", "ai_total", "human_total_anchors", "anchors_caught", "anchors_missed", "missed_anchors"))


def q_top_index(spark, sf_dir):
    c = run_counts(spark, sf_dir)
    return plain(report.top_index(c.unionByName(c.withColumn("version_id", F.lit("xml_cot")).withColumn("ai_total", F.lit(0).cast("long")))))


def q_ai_only(spark, sf_dir):
    cards = event_cards(spark, sf_dir)
    s = cards.where("anchor_id is not null").select("doc_id", "anchor_id").distinct().select("doc_id", "anchor_id", F.substring("anchor_id", 2, 2).cast("int").alias("sentence_idx"), F.concat(F.lit("text "), "anchor_id").alias("text"))
    return plain(report.ai_rows(cards, align.anchor_sources(cards), s))


RULES = [("tion", "Risk", "c1", "s1", None), ("ment", "Risk Mitigation", "c1", "s2", 2), ("schaft", "Risk", "odd", "s1", None), ("ciones", "Risk Mitigation", "c1", "s1", None)]


def q_run_strategy(spark, sf_dir):
    """A whole run: blocks of 20 sentences, rule annotator, de-duplication, validation."""
    run = lifecycle.run_strategy(spread(table(spark, sf_dir, "documents")), Strategy("t", "t", "t", "n_sentence", {"n_sentences": 20, "stride": 15}), RuleAnnotator(RULES), small_taxonomy(spark))
    return plain(run.annotations.groupBy("doc_id", "kind", "category", "subcategory", "strength").agg(F.count(F.lit(1)).alias("n")))


def _run_phases(version):
    def query(spark, sf_dir):
        """A phased workflow with every phase answered by rules."""
        docs = spread(table(spark, sf_dir, "documents"))
        run = lifecycle.run_strategy(docs, get_strategy(version), PhaseRules(RULES, about="on|en", passage="schaft|ment", idle="the"), small_taxonomy(spark))
        return plain(run.annotations.groupBy("doc_id", "kind", "category", "subcategory", "strength").agg(F.count(F.lit(1)).alias("n")))

    return query


def q_reply_items(spark, sf_dir):
    """Answers of three items with odd and extra fields, every other one cut off somewhere: the whole items are kept."""
    o = table(spark, sf_dir, "orders")
    item = F.concat(F.lit('{"sentence":"\\"{'), "o_orderpriority", F.lit('}","kind":"Risk","strength":"'), (F.col("o_orderkey") % 4).cast("string"), F.lit('","note":[1,2]}'))
    content = F.concat(F.lit('{"annotations":['), item, F.lit(","), item, F.lit(","), item, F.lit("]}"))
    cut = F.when(F.col("o_orderkey") % 2 == 0, F.left(content, F.length(content) - (F.col("o_orderkey") % 150).cast("int"))).otherwise(content)
    message = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "length").otherwise("stop").alias("finish_reason"), F.struct(cut.alias("content")).alias("message"))
    rows = reply_items(o.select("o_orderkey", F.to_json(F.struct(F.array(message).alias("choices"))).alias("raw_response")))
    first = F.get("items", F.lit(0))
    return plain(rows.select("o_orderkey", "status", F.size("items").alias("n"), first["sentence"].alias("sentence"), first["strength"].alias("strength"), F.array_join(first["extra"], ",").alias("extra")))


def q_parse_replies(spark, sf_dir):
    """Replies of all four states: answered, refused, cut off, empty."""
    d = table(spark, sf_dir, "orders")
    content = F.to_json(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("sentence"), F.lit("Risk").alias("kind"))).alias("annotations")))
    message = lambda **k: F.struct(*(v.alias(n) for n, v in k.items())).alias("message")
    reply = lambda reason, **k: F.to_json(F.struct(F.array(F.struct(F.lit(reason).alias("finish_reason"), message(**k))).alias("choices")))
    n = F.col("o_orderkey") % 4
    raw = F.when(n == 0, reply("stop", refusal=F.lit("no"))).when(n == 1, reply("length", content=F.lit("{"))).when(n == 2, reply("stop", content=F.lit(""))).otherwise(reply("stop", content=content))
    rows = parse_reply(d.select(F.col("o_orderkey").alias("doc_id"), F.lit("chunk_0002").alias("chunk_id"), raw.alias("raw_response")))
    chunk, place = F.shiftright("seq", 31), F.col("seq").bitwiseAND(F.lit(2**31 - 1))
    found = annotations_of(rows.where("status = 'ok'")).select("doc_id", (chunk * 100_000 + place).alias("seq"), "sentence", "kind")
    return rows.select("doc_id", "status").join(found, "doc_id", "left")


QUERIES = {
    "html_extract": q_html_extract, "html_cases": q_html_cases, "html_nested": q_html_nested, "normalize_text": q_normalize_text, "labels_clean": q_labels_clean, "sentence_index": q_sentence_index, "keyword_hits": q_keyword_hits, "keyword_hits_large": q_keyword_hits_large,
    "coverage": q_coverage, "chunks_full": _ranges("full_doc"), "chunks_window": _ranges("keyword_window", True, window_sentences=3),
    "chunks_sentence": _ranges("keyword_per_sentence", True), "chunks_n20": _ranges("n_sentence", n_sentences=20), "chunks_n40": _ranges("n_sentence", n_sentences=40),
    "chunks_overlap": _ranges("n_sentence", n_sentences=7, stride=4), "chunks_gaps": _ranges("n_sentence", n_sentences=3, stride=5), "chunk_texts": q_chunk_texts, "chunk_texts_joined": q_chunk_texts_joined,
    "row_chunks_full": _row_ranges("full_doc"), "row_chunks_window": _row_ranges("keyword_window", window_sentences=3), "row_chunks_sentence": _row_ranges("keyword_per_sentence"),
    "row_chunks_overlap": _row_ranges("n_sentence", n_sentences=7, stride=4),
    "context_window": q_context_window, "passage_members": q_passage_members, "dedupe_first": q_dedupe_first, "validate_reasons": q_validate_reasons,
    "validate_kept": q_validate_kept, "resolve_category": q_resolve_category, "align_cascade": q_align_cascade, "align_cards": q_align_cards,
    "anchor_sources": q_anchor_sources, "align_counts": q_align_counts, "label_frame": _label_frame("union"), "label_frame_both": _label_frame("intersection"),
    "label_frame_unmatched": _label_frame_unmatched("union"), "label_frame_both_unmatched": _label_frame_unmatched("intersection"), "comparison_unmatched": q_comparison_unmatched,
    "frame_rows": q_frame_rows, "prf_per_category": q_prf_per_category, "prf_averages": q_prf_averages, "prf_displayed": q_prf_displayed, "kappa": q_kappa,
    "confusion_category": q_confusion_category, "confusion_strength": q_confusion_strength, "confusion_headlines": q_confusion_headlines,
    "strength_headline": q_strength_headline, "strength_levels": q_strength_levels, "fp_counts": q_fp_counts, "comparison": q_comparison, "labels_prf": q_labels_prf,
    "sentence_disputes": q_sentence_disputes, "tag_disputes": q_tag_disputes, "final_labels": q_final_labels, "final_parts": q_final_parts,
    "filing_summary": q_filing_summary, "adjudication_report": q_adjudication_report, "span_collapse": q_span_collapse, "coder_names": q_coder_names,
    "sequential": q_sequential, "passage_aware": q_passage_aware, "diagnosis_passages": q_diagnosis_passages, "diagnosis_phases": q_diagnosis_phases,
    "loss_buckets": q_loss_buckets, "missed_anchors": q_missed_anchors, "few_shot": q_few_shot, "annotation_rows": q_annotation_rows,
    "paragraph_tokens": q_paragraph_tokens, "paragraph_tokens_joined": q_paragraph_tokens_joined, "split_index": q_split_index, "experiment_log": q_experiment_log, "top_index": q_top_index, "ai_only": q_ai_only,
    "run_strategy": q_run_strategy, "run_sequential": _run_phases("sequential_batched"), "run_passage_aware": _run_phases("sequential_passage_aware"), "parse_replies": q_parse_replies,
    "reply_items": q_reply_items,
}

QUERIES |= catalog_io.QUERIES
