"""Prompts and answer schemas, from the taxonomy alone: human labels are never read here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "annotations array<struct<sentence:string,kind:string,category:string,subcategory:string,strength:int,reasoning:string>>"
VERDICTS = {
    "candidates": "verdicts array<struct<anchor_id:string>>",
    "kind": "verdicts array<struct<anchor_id:string,kind:string>>",
    "category": "verdicts array<struct<anchor_id:string,category:string,subcategory:string>>",
    "strength": "verdicts array<struct<anchor_id:string,strength:int>>",
    "context": "verdicts array<struct<anchor_id:string,keep:boolean,reason:string>>",
    "passages": "passages array<struct<start_anchor:string,end_anchor:string,topic_summary:string>>",
}
#: Phase -> the shape of its verdicts.
PHASES = {
    "p1_candidates": "candidates", "p2_kind": "kind", "p3a_risk_cats": "category", "p3b_mit_cats": "category", "p4_strength": "strength",
    "p1_passages": "passages", "p2_outside_mentions": "candidates", "p3_context_filter": "context", "p4_kind": "kind",
    "p5a_risk_cats": "category", "p5b_mit_cats": "category", "p6_strength": "strength",
}
HALF = {"p3a_risk_cats": "Risk", "p5a_risk_cats": "Risk", "p3b_mit_cats": "Risk Mitigation", "p5b_mit_cats": "Risk Mitigation"}
TASKS = {
    "candidates": "The text has numbered sentences, `[s-00000] sentence`. List the anchor of every sentence that is itself about the topic, and of no other.",
    "passages": "The text has numbered sentences, `[s-00000] sentence`. List the stretches that are about the topic as a whole: first anchor, last anchor, one line on what the stretch says.",
    "context": "Each block has a target sentence, what its passage is about, and the sentences around it, the target marked by `>>`. For each target say whether it states a risk or a mitigation in this context, and why.",
    "kind": "For each numbered sentence decide: Risk, Risk Mitigation, or null for neither.",
    "category": "For each numbered sentence choose one category and one subcategory of the table.",
    "strength": "Grade each numbered sentence, all of them mitigations, from 1 to 3 by the rubric.",
}


def markdown_table(header: tuple[str, ...], rows: list[tuple]) -> str:
    line = lambda cells: "| " + " | ".join(str(c if c is not None else "").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *(line(r) for r in rows)])


def system_prompt(taxonomy: DataFrame, rubric: DataFrame | None = None, assumptions: DataFrame | None = None, rules: str = "", examples: str = "", reasoned: bool = False) -> str:
    """The instructions: task, label tables, rubric, assumptions, and if given rules and examples."""
    parts = ["Label every sentence of the text that states a risk or a mitigation. Copy sentences word for word. Use only the labels below."]
    for kind in ("Risk", "Risk Mitigation"):
        rows = taxonomy.where(F.col("kind") == kind).orderBy("category", "subcategory").collect()
        parts.append(f"## {kind}\n" + markdown_table(("category", "subcategory", "description"), [(r.category, r.subcategory, r.description) for r in rows]))
    if rubric is not None:
        parts.append("## Strength of a mitigation\n" + markdown_table(("strength", "meaning"), [tuple(r) for r in rubric.orderBy("strength").collect()]))
    if assumptions is not None:
        parts.append("## Assumptions\n" + "\n".join(f"- {r.assumption}" for r in assumptions.collect()))
    parts += [f"## {title}\n{body}" for title, body in (("Rules", rules), ("Examples", examples)) if body]
    if reasoned:
        parts.append("Give your reasoning for each label first, in the field `reasoning`.")
    return "\n\n".join(parts)


def phase_prompt(phase: str, taxonomy: DataFrame, rubric: DataFrame | None = None, rules: str = "") -> str:
    """The instructions of one phase of a workflow: its task, for categories the labels of its half, for strengths the rubric, and rules."""
    parts = [TASKS[PHASES[phase]]]
    if phase in HALF:
        rows = taxonomy.where(F.col("kind") == HALF[phase]).orderBy("category", "subcategory").collect()
        described = "description" in taxonomy.columns
        parts.append(f"## {HALF[phase]}\n" + markdown_table(("category", "subcategory", "description"), [(r.category, r.subcategory, r.description if described else "") for r in rows]))
    if PHASES[phase] == "strength" and rubric is not None:
        parts.append("## Strength\n" + markdown_table(("strength", "meaning"), [tuple(r) for r in rubric.orderBy("strength").collect()]))
    if rules:
        parts.append(f"## Rules\n{rules}")
    return "\n\n".join(parts)


def _listed(name: str, **fields: dict) -> dict:
    """A JSON schema of an object with one list of objects, every field required and no other allowed."""
    item = {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}
    return {"type": "object", "additionalProperties": False, "required": [name], "properties": {name: {"type": "array", "items": item}}}


def answer_schema(taxonomy: DataFrame, reasoned: bool = False) -> dict:
    """The JSON schema of a whole answer: kinds, categories and subcategories are those of the taxonomy, strengths 1 to 3 or null."""
    values = lambda c: sorted(r[0] for r in taxonomy.select(c).distinct().collect())
    fields = {
        "sentence": {"type": "string"}, "kind": {"type": "string", "enum": values("kind")}, "category": {"type": "string", "enum": values("category")},
        "subcategory": {"type": "string", "enum": values("subcategory")}, "strength": {"type": ["integer", "null"], "enum": [1, 2, 3, None]},
    }
    return _listed("annotations", **({"reasoning": {"type": "string"}} if reasoned else {}), **fields)


def phase_schema(phase: str, taxonomy: DataFrame) -> dict:
    """The JSON schema of a phase's reply; categories and subcategories are those of the phase's half of the taxonomy."""
    text, shape = {"type": "string"}, PHASES[phase]
    if shape == "passages":
        return _listed("passages", start_anchor=text, end_anchor=text, topic_summary=text)
    half = taxonomy.where(F.col("kind") == HALF[phase]) if phase in HALF else taxonomy
    values = lambda c: {"type": "string", "enum": sorted(r[0] for r in half.select(c).distinct().collect())}
    own = {
        "candidates": lambda: {}, "kind": lambda: {"kind": {"type": ["string", "null"], "enum": ["Risk", "Risk Mitigation", None]}},
        "category": lambda: {"category": values("category"), "subcategory": values("subcategory")},
        "strength": lambda: {"strength": {"type": "integer", "enum": [1, 2, 3]}}, "context": lambda: {"keep": {"type": "boolean"}, "reason": text},
    }
    return _listed("verdicts", anchor_id=text, **own[shape]())


def context_blocks(rows: DataFrame) -> DataFrame:
    """doc_id, text: a block for each candidate (anchor_id, text, topic_summary, context) in document order."""
    block = F.concat(
        F.lit("target: ["), "anchor_id", F.lit("] "), "text", F.lit("\nsummary: "), F.coalesce("topic_summary", F.lit("(outside of passages)")), F.lit("\ncontext:\n"), "context"
    )
    blocks = F.array_sort(F.collect_list(F.struct("sentence_idx", block.alias("b"))))
    return rows.groupBy("doc_id").agg(F.array_join(blocks["b"], "\n\n").alias("text"))


def numbered(sentences: DataFrame) -> DataFrame:
    """doc_id, text: sentences as ``[anchor] text`` lines in document order."""
    line = F.concat(F.lit("["), "anchor_id", F.lit("] "), "text")
    lines = F.array_sort(F.collect_list(F.struct("sentence_idx", line.alias("l"))))
    return sentences.groupBy("doc_id").agg(F.array_join(lines["l"], "\n").alias("text"))


def examples_block(examples: DataFrame) -> str:
    """Chosen feedback rows (a handful) as markdown."""
    rows = examples.orderBy("part", "rank").collect()
    return "\n\n".join(f"**{r.decision}** ({r.explanation})\n> {r.sentence}\n{r.explanation_long}" for r in rows)
