"""Phased workflows end to end: each phase is asked about what the one before kept, for all documents at once.

A document stays one row: its sentences are an array, and what a phase said is one more small array beside it.  A phase's input is made from
the sentences at the places that were kept; verdicts on other anchors are left out, as in ``operators.phases``, whose results these
are.  An annotator that answers within the row (``reply``) makes a whole workflow one pass without a shuffle.  Others get the texts
and give replies by document; then sentences are dealt by document once, and only replies move after that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, computed
from ..functions.text import anchor_id, anchor_place
from ..operators.phases import MITIGATION, RISK
from ..scratch import settled
from .annotators import Annotator, parse_reply, replied
from .prompts import PHASES, VERDICTS, phase_prompt

PLACES = "array<int>"


def places(verdicts: str) -> Column:
    """The distinct places of verdicts that the document has."""
    found = F.transform(verdicts, lambda v: anchor_place(v["anchor_id"]))
    return F.array_distinct(F.filter(found, lambda i: i.isNotNull() & (i < F.size("_lines"))))


def about(kept: str | Column) -> Column:
    """The numbered sentences at some places, in document order."""
    return F.array_join(F.transform(F.array_sort(kept), lambda i: F.get("_lines", i)), "\n")


def blocks(candidates: str, before: int, after: int) -> Column:
    """A block for each candidate (i, topic_summary): the sentence, what its passage is about, and the lines around it, its own marked."""

    def block(c: Column) -> Column:
        first = F.greatest(F.lit(0), c["i"] - before)
        near = F.slice("_lines", first + 1, c["i"] + after - first + 1)
        context = F.array_join(F.transform(near, lambda x, k: F.concat(F.when(first + k == c["i"], ">> ").otherwise("   "), x)), "\n")
        return F.concat(F.lit("target: "), F.get("_lines", c["i"]), F.lit("\nsummary: "), F.coalesce(c["topic_summary"], F.lit("(outside of passages)")), F.lit("\ncontext:\n"), context)

    return F.array_join(F.transform(candidates, block), "\n\n")


@dataclass
class Phases:
    """Whom a workflow asks and with what: see :func:`phase_prompt`.  ``folder`` keeps replies by ``version``, so that a rerun asks only for what is missing."""

    annotator: Annotator
    taxonomy: DataFrame
    rubric: DataFrame | None = None
    rules: str = ""
    folder: str | None = None
    version: str = ""

    def begin(self, sentences: DataFrame) -> DataFrame:
        """doc_id, sentences (array) and _lines; sentences by row are gathered.  They are dealt by document if replies come from elsewhere."""
        if "sentences" not in sentences.columns:
            own = F.array_sort(F.collect_list(F.struct("sentence_idx", "text")))
            sentences = sentences.groupBy("doc_id").agg(own.alias("sentences"))
        rows = computed(sentences.select("doc_id", "sentences"), _texts=F.transform("sentences", lambda x: x["text"])).drop("sentences")
        if self.folder or self.annotator.reply(F.lit(""), F.lit("")) is None:
            rows = settled(rows.repartition("doc_id"))
        return computed(rows, _lines=F.transform("_texts", lambda x, i: F.concat(F.lit("["), anchor_id(i), F.lit("] "), x)))

    def ask(self, phase: str, rows: DataFrame, text: Column, into: str) -> DataFrame:
        """``rows`` with ``into``: the phase's verdicts on ``text`` in the order of the reply, none where nothing was asked or answered."""
        prompt, kind = phase_prompt(phase, self.taxonomy, self.rubric, self.rules), VERDICTS[PHASES[phase]]
        rows = replied(self.annotator, computed(rows, text=text).withColumn("chunk_id", F.lit(phase)), prompt, self.version, self.folder)
        parsed = parse_reply(rows, schema=kind)
        name, _, listed = kind.partition(" ")
        verdicts = F.coalesce(F.filter(F.col(f"answer.{name}"), lambda v: v.isNotNull()), F.array().cast(listed))
        return computed(parsed, **{into: verdicts}).drop("text", "chunk_id", "raw_response", "status", "answer")

    def labelled(self, rows: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
        """The phases from the kind on, about the places ``_kept``; then the labels by row."""
        rows = self.ask(names[0], rows, about("_kept"), "_said")
        asked = F.filter(F.transform("_said", lambda v: F.struct(anchor_place(v["anchor_id"]).alias("i"), v["kind"].alias("kind"))), lambda v: F.array_contains("_kept", v["i"]))
        half = lambda kind: F.array_distinct(F.transform(F.filter("_kinds", lambda v: v["kind"] == kind), lambda v: v["i"]))
        rows = computed(computed(rows, _kinds=asked), _risks=half(RISK), _mits=half(MITIGATION)).drop("_said", "_kinds", "_kept")
        rows = self.ask(names[1], rows, about("_risks"), "_risk_cats")
        rows = self.ask(names[2], rows, about("_mits"), "_mit_cats")
        rows = self.ask(names[3], computed(rows, _graded=F.array_intersect(places("_mit_cats"), "_mits")), about("_graded"), "_strengths")
        graded = F.transform("_strengths", lambda v: F.struct(anchor_place(v["anchor_id"]).alias("i"), v["strength"].alias("strength")))
        rows = computed(rows, _grades=graded)

        def labels(cats: str, among: str, kind: str, strength) -> Column:
            each = F.transform(cats, lambda v, seq: F.struct(anchor_place(v["anchor_id"]).alias("i"), v["category"].alias("category"), v["subcategory"].alias("subcategory"), seq.alias("seq")))
            kept = F.filter(each, lambda v: F.array_contains(among, v["i"]))
            return F.transform(kept, lambda v: F.struct(v["i"].alias("i"), F.lit(kind).alias("kind"), v["category"].alias("category"), v["subcategory"].alias("subcategory"), strength(v).alias("strength"), v["seq"].alias("seq")))

        last = lambda v: F.try_element_at(F.filter("_grades", lambda g: g["i"] == v["i"]), F.lit(-1))["strength"]
        both = F.concat(labels("_risk_cats", "_risks", RISK, lambda v: F.lit(None).cast("int")), labels("_mit_cats", "_mits", MITIGATION, last))
        each = rows.select("doc_id", F.explode(F.transform(both, lambda x: F.struct(x.alias("x"), F.get("_texts", x["i"]).alias("sentence")))).alias("l"))
        return each.select("doc_id", anchor_id(F.col("l.x.i")).alias("anchor_id"), "l.sentence", "l.x.kind", "l.x.category", "l.x.subcategory", "l.x.strength", "l.x.seq")


def sequential(sentences: DataFrame, run: Phases) -> DataFrame:
    """Four phases: candidates, kind, category, strength."""
    rows = run.begin(sentences)
    rows = run.ask("p1_candidates", rows, F.array_join("_lines", "\n"), "_said")
    rows = computed(rows, _kept=places("_said")).drop("_said")
    return run.labelled(rows, ("p2_kind", "p3a_risk_cats", "p3b_mit_cats", "p4_strength"))


def passage_aware(sentences: DataFrame, run: Phases, around: int = 8) -> DataFrame:
    """Six phases: passages, sweep outside of them, context filter, kind, category, strength."""
    rows = run.begin(sentences)
    rows = run.ask("p1_passages", rows, F.array_join("_lines", "\n"), "_said")
    ends = lambda v: F.struct(anchor_place(v["start_anchor"]).alias("a"), anchor_place(v["end_anchor"]).alias("b"), v["topic_summary"].alias("topic_summary"))
    known = lambda p: (p["a"] < F.size("_lines")) & (p["b"] < F.size("_lines"))
    rows = computed(rows, _passages=F.filter(F.transform("_said", ends), known)).drop("_said")
    every = F.when(F.size("_lines") > 0, F.sequence(F.lit(0), F.size("_lines") - 1)).otherwise(F.array().cast(PLACES))
    over = lambda i: F.filter("_passages", lambda p: i.between(F.least(p["a"], p["b"]), F.greatest(p["a"], p["b"])))
    last = lambda i: bound(F.try_element_at(over(i), F.lit(-1)), lambda p: F.struct(i.alias("i"), p.isNotNull().alias("met"), p["topic_summary"].alias("topic_summary")))
    rows = computed(rows, _inside=F.filter(F.transform(every, last), lambda x: x["met"]))
    rows = computed(rows, _outside=F.array_except(every, F.transform("_inside", lambda x: x["i"])))
    rows = run.ask("p2_outside_mentions", rows, about("_outside"), "_said")
    alone = F.transform(F.array_intersect(places("_said"), "_outside"), lambda i: F.struct(i.alias("i"), F.lit(True).alias("met"), F.lit(None).cast("string").alias("topic_summary")))
    rows = computed(rows, _candidates=F.array_sort(F.concat("_inside", alone))).drop("_said", "_inside", "_outside", "_passages")
    rows = run.ask("p3_context_filter", rows, blocks("_candidates", around, around), "_said")
    rows = computed(rows, _good=F.filter("_said", lambda v: v["keep"]))
    rows = computed(rows, _kept=F.array_intersect(places("_good"), F.transform("_candidates", lambda x: x["i"]))).drop("_said", "_good", "_candidates")
    return run.labelled(rows, ("p4_kind", "p5a_risk_cats", "p5b_mit_cats", "p6_strength"))


WORKFLOWS = {"sequential": sequential, "passage_aware": passage_aware}
