"""Annotators: chunks in, annotations out.

``Annotator.annotate`` is the extension point.  The default is a deterministic rule table, which needs no network; a model
behind a service is called through ``CallAnnotator``, Arrow batch by batch.  Answers are kept in a table keyed by version,
chunk and a hash of the prompt and text, so a rerun asks only for what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, computed
from ..scratch import settled
from .prompts import ANSWER

OK, ERROR, TRUNCATED, EMPTY = "ok", "refused", "truncated", "empty"
REPLY = "choices array<struct<finish_reason:string,message:struct<refusal:string,content:string>>>"


def parse_reply(rows: DataFrame, raw: str = "raw_response", schema: str = ANSWER) -> DataFrame:
    """Adds ``status`` and ``answer`` (null unless ok) to rows with a raw reply."""
    first = F.try_element_at(F.from_json(raw, REPLY)["choices"], F.lit(1))
    rows = rows.withColumn("_m", first)
    content = F.coalesce(F.col("_m.message.content"), F.lit(""))
    status = (
        F.when(F.coalesce(F.col("_m.message.refusal"), F.lit("")) != "", ERROR).when(F.col("_m.finish_reason") == "length", TRUNCATED)
        .when(content == "", EMPTY).otherwise(OK)
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("answer", F.when(F.col("status") == OK, F.from_json(content, schema))).drop("_m")


#: An object, which may hold objects that hold none; signs within its strings are none of its own.
_FLAT = r'[^{}"]|"(?:[^"\\]|\\.)*+"'
ITEM = rf"\{{(?:{_FLAT}|\{{(?:{_FLAT})*+\}})*+\}}"
FIELDS = {"sentence": "string", "kind": "string", "category": "string", "subcategory": "string", "strength": "int", "reasoning": "string"}


def reply_items(rows: DataFrame, raw: str = "raw_response", fields: dict[str, str] | None = None) -> DataFrame:
    """Adds ``status`` and ``items``: the whole items of an answer, also of one that was cut off, each read on its own.

    A field of another type is converted if it can be, else null; ``extra`` lists the names of fields that are not among ``fields``, and
    what has none of them is no item.
    """
    fields = fields or FIELDS

    def item(text: Column) -> Column:
        values = lambda v: F.struct(*(F.try_variant_get(v, f"$.{name}", kind).alias(name) for name, kind in fields.items()), extra.alias("extra"))
        extra = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*(F.lit(f) for f in fields)))
        known = F.size(extra) < F.size(F.array_distinct(F.json_object_keys(text)))
        return bound(F.try_parse_json(text), lambda v: F.when(v.isNotNull() & known, values(v)))

    rows = parse_reply(rows, raw).withColumn("_m", F.try_element_at(F.from_json(raw, REPLY)["choices"], F.lit(1)))
    content = F.when(F.col("status").isin(OK, TRUNCATED), F.col("_m.message.content"))
    listed = F.regexp_replace(F.coalesce(content, F.lit("")), r'^\s*\{\s*"[^"]*"\s*:\s*\[', "")
    found = F.filter(F.transform(F.regexp_extract_all(listed, F.lit(ITEM), F.lit(0)), item), lambda x: x.isNotNull())
    return computed(rows, items=found).drop("_m", "answer")


def annotations_of(parsed: DataFrame) -> DataFrame:
    """doc_id, seq, sentence and labels of parsed replies, numbered by chunk and place."""
    rows = parsed.select("doc_id", "chunk_id", F.posexplode("answer.annotations").alias("at", "a")).select("doc_id", "chunk_id", "at", "a.*")
    number = F.shiftleft(F.regexp_extract("chunk_id", "([0-9]+)$", 1).cast("long"), 31) + F.col("at")  # a place is an int
    return rows.withColumn("seq", number).drop("chunk_id", "at")


class Annotator:
    """chunks (doc_id, chunk_id, text) -> doc_id, chunk_id, raw_response.

    ``reply`` gives the answer as a Column of a chunk's text and id, if it can be had within the row.
    """

    def annotate(self, chunks: DataFrame, prompt: str) -> DataFrame:
        raise NotImplementedError

    def reply(self, text: Column, chunk: Column) -> Column | None:
        return None


def _stopped(content: Column) -> Column:
    """A complete raw reply with this content."""
    choice = F.struct(F.lit("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    return F.to_json(F.struct(F.array(choice).alias("choices")))


class RuleAnnotator(Annotator):
    """Labels each line of a chunk by the first rule (pattern, kind, category, subcategory, strength) that it matches."""

    def __init__(self, rules: list[tuple[str, str, str, str, int | None]]):
        self.rules = rules

    def label(self, text: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,category:string,subcategory:string,strength:int>")
        for pattern, kind, category, subcategory, strength in reversed(self.rules):
            own = F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), F.lit(strength).cast("int").alias("strength"))
            out = F.when(text.rlike(f"(?iu){pattern}"), own).otherwise(out)
        return out

    def reply(self, text: Column, chunk: Column) -> Column:
        found = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("sentence"), self.label(x).alias("l"))), lambda x: x["l"].isNotNull())
        flat = F.transform(found, lambda x: F.struct(x["sentence"].alias("sentence"), *(x["l"][c].alias(c) for c in ("kind", "category", "subcategory", "strength"))))
        return _stopped(F.to_json(F.struct(flat.alias("annotations"))))

    def annotate(self, chunks: DataFrame, prompt: str = "") -> DataFrame:
        return chunks.select("doc_id", "chunk_id", self.reply(F.col("text"), F.col("chunk_id")).alias("raw_response"))


class PhaseRules(RuleAnnotator):
    """Answers every phase of a workflow by rules; the phase is the chunk's id.

    ``about``: what makes a candidate or a mention; ``passage``: what begins a passage, which ends a sentence later; ``idle``: what the
    context filter drops.  Kinds, categories and strengths are those of the first rule that a sentence matches.
    """

    def __init__(self, rules: list[tuple[str, str, str, str, int | None]], about: str, passage: str, idle: str):
        super().__init__(rules)
        self.about, self.passage, self.idle = (f"(?iu){x}" for x in (about, passage, idle))

    def reply(self, text: Column, chunk: Column) -> Column:
        named = r"(?s)^(?:target: )?\[(s-[0-9]+)\] (.*?)(?:\nsummary: .*)?$"

        def one(x: Column) -> Column:
            said = F.regexp_extract(x, named, 2)
            return bound(said, lambda t: F.struct(F.regexp_extract(x, named, 1).alias("a"), t.alias("t"), self.label(t).alias("l")))

        cut = F.split(text, r"\n\n(?=target: \[s-[0-9]+\] )|\n(?=\[s-[0-9]+\] )")
        return bound(F.filter(F.transform(cut, one), lambda x: x["a"] != ""), lambda xs: self._answer(xs, chunk))

    def _answer(self, xs: Column, chunk: Column) -> Column:
        some = lambda pattern: F.filter(xs, lambda x: x["t"].rlike(pattern))
        each = lambda of, *cols: F.transform(of, lambda x: F.struct(x["a"].alias("anchor_id"), *(x["l"][c].alias(c) for c in cols)))
        met = F.filter(xs, lambda x: x["l"].isNotNull())
        after = lambda i: F.coalesce(F.get(xs, i + 1)["a"], F.get(xs, i)["a"])
        begun = F.filter(F.transform(xs, lambda x, i: F.struct(x["a"].alias("start_anchor"), after(i).alias("end_anchor"), F.concat(F.lit("topic "), x["a"]).alias("topic_summary"),
                                                               x["t"].rlike(self.passage).alias("on"))), lambda x: x["on"])
        context = F.transform(xs, lambda x: F.struct(x["a"].alias("anchor_id"), (~x["t"].rlike(self.idle)).alias("keep"), F.lit("rule").alias("reason")))
        json = lambda of, name="verdicts": F.to_json(F.struct(of.alias(name)))
        phase = F.regexp_replace(chunk, "^p[0-9][ab]?_", "")
        return _stopped(
            F.when(phase.isin("candidates", "outside_mentions"), json(each(some(self.about)))).when(phase == "passages", json(begun, "passages"))
            .when(phase == "context_filter", json(context)).when(phase == "kind", json(each(xs, "kind"))).when(phase == "strength", json(each(met, "strength")))
            .otherwise(json(each(met, "category", "subcategory")))
        )


class CallAnnotator(Annotator):
    """Asks ``call(prompt, text) -> raw reply`` for each chunk on the executors; a call that fails has an empty reply."""

    def __init__(self, call: Callable[[str, str], str]):
        self.call = call

    def annotate(self, chunks: DataFrame, prompt: str) -> DataFrame:
        call = self.call

        def run(batches):
            def ask(text):
                try:
                    return call(prompt, text)
                except Exception as e:  # noqa: BLE001  a failed call costs its chunk only, and its status says so
                    return '{"choices": [], "error": "%s"}' % type(e).__name__

            for batch in batches:
                yield batch[["doc_id", "chunk_id"]].assign(raw_response=[ask(t) for t in batch["text"]])

        kind = chunks.schema["doc_id"].dataType.simpleString()
        return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_id string, raw_response string")


def annotate_cached(annotator: Annotator, chunks: DataFrame, prompt: str, version: str, folder: str, parts: int = 1) -> DataFrame:
    """Raw replies of all chunks; only those that the table under ``folder`` lacks are asked for, and appended.

    Replies are committed in ``parts`` by a hash of the chunk, one after the other, so that a run which is cut off goes on behind the last
    part that it committed.  Of replies that two runs have appended for one chunk, one is read.
    """
    spark, path = chunks.sparkSession, f"{folder}/replies"
    key = ["doc_id", "chunk_id", "input_hash"]
    keyed = chunks.withColumn("input_hash", F.sha2(F.concat(F.lit(prompt + "\x1f"), F.col("text")).cast("binary"), 256))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    todo = keyed
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        have = settled(spark.read.parquet(path).where(F.col("version_id") == version).select(*key))  # what is appended below is not read here
        todo = keyed.join(have, key, "left_anti")
    for part in range(parts):
        own = todo.where(F.pmod(F.xxhash64("doc_id", "chunk_id"), F.lit(parts)) == part) if parts > 1 else todo
        fresh = annotator.annotate(own, prompt).join(own.select(*key), ["doc_id", "chunk_id"])
        fresh.withColumn("version_id", F.lit(version)).write.mode("append").parquet(path)
    kept = spark.read.parquet(path).where(F.col("version_id") == version).groupBy(*key).agg(F.min("raw_response").alias("raw_response"))
    return kept.join(keyed.select(*key), key, "left_semi")


def replied(annotator: Annotator, rows: DataFrame, prompt: str, version: str = "", folder: str | None = None) -> DataFrame:
    """``rows`` (doc_id, chunk_id, text and more; one chunk a document) with ``raw_response``, null where the text is empty.

    Within the row if the annotator can and nothing is to be kept; else from the settled replies, which are small beside the rows.
    """
    own = None if folder else annotator.reply(F.col("text"), F.col("chunk_id"))
    if own is not None:
        return computed(rows, raw_response=F.when(F.col("text") != "", own))
    chunks = rows.select("doc_id", "chunk_id", "text").where("text != ''")
    raw = annotate_cached(annotator, chunks, prompt, version, folder) if folder else settled(annotator.annotate(chunks, prompt))
    return rows.join(raw.select("doc_id", "raw_response"), "doc_id", "left")
