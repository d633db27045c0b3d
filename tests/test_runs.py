import json

import pytest

from pyspark.sql import functions as F

from marginalia.plans import annotators, lifecycle, prompts, strategies
from marginalia.sources import files, sinks
from marginalia.streaming import incremental

TWO = '''preamble,,,
Acme,,,,,,,,
Company,10-K Year,AI_Term,Coder A Name,Coder A: Sentences Highlighted,Coder A: Risk or Mitigation?,Coder A: Subcategory,Coder A: Strength Annotation,Coder B: Sentences Highlighted,Descripancy Type
x,2024,ai,Ann,"One
line",Mitigation,IP,2.0,,d
x,n/a,ai,Ann,Two,Risk,IP,,,
Beta,,,,,,,,
Company,AI_Term,10-K Year,Coder B: Sentences Highlighted,Coder B: Risk or Mitigation?
x,ai,2023,Three,risk
'''


def test_two_coder_file(spark, tmp_path):
    (tmp_path / "h.csv").write_text(TWO)
    rows = files.read_two_coders(spark, str(tmp_path / "h.csv"), {"Acme": "acme", "Beta": "beta"})
    got = [(r.company, r.company_slug, r.year, r.coder, r.sentence, r.kind, r.strength) for r in rows.orderBy("seq").collect()]
    assert got == [("Acme", "acme", 2024, "A", "One\nline", "Risk Mitigation", 2), ("Beta", "beta", 2023, "B", "Three", "Risk", None)]
    assert files.human_for_doc(rows, "beta", 2023).count() == 1


def by_hand(text, known):
    """The rows of a two-coder file, record by record."""
    import csv
    import io

    company = places = None
    for cells in csv.reader(io.StringIO(text)):
        cells = [c.strip() for c in cells]
        if cells and cells[0].lower() in known and not any(cells[1:]):
            company, places = cells[0], None
        elif cells and cells[0] == "Company" and {"10-K Year", "AI_Term"} & set(cells):
            places = {c: i for i, c in enumerate(cells)}
        elif company and places:
            get = lambda c, row=cells, at=places: row[at[c]] if c in at and at[c] < len(row) else ""
            if get("10-K Year").isdigit():
                yield from ((company, int(get("10-K Year")), x, s) for x in "AB" if (s := get(f"Coder {x}: Sentences Highlighted")))


@pytest.mark.parametrize("size", [40, 97, 1 << 20])
def test_a_file_is_read_block_by_block(spark, tmp_path, size):
    """Sections, headers and quoted line breaks that blocks of any size cut anywhere."""
    import random

    rng, names = random.Random(8), ["Acme", "Beta", "Gamma Co"]
    head = ["Company", "10-K Year", "AI_Term", "Coder A: Sentences Highlighted", "Coder B: Sentences Highlighted"]
    out = ["notes,,\n"]
    for k in range(14):
        out.append(f"{rng.choice(names)},,,\n")
        if k % 5 == 4:
            out.append("x,2020,ai,lost as there is no header,\n")
        cols = head[:1] + rng.sample(head[1:], 4)
        out += [",".join(cols) + "\n"] * (k % 5 != 4)
        for i in range(rng.randrange(0, 9)):
            said = {"10-K Year": rng.choice(["2021", "n/a", " 2022 "]), "AI_Term": "ai", head[3]: f'"One, ""{i}""\n\nAcme,,,\nmore {"y" * rng.randrange(90)}"', head[4]: rng.choice(["", "Two", '"\n,"'])}
            out.append(",".join(["x", *(said[c] for c in cols[1:])]) + "\n")
    text = "".join(out)
    (tmp_path / "one").mkdir()
    (tmp_path / "one/h.csv").write_text(text)
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, str(size))
    try:
        rows = files.read_two_coders(spark, str(tmp_path / "one"), {n: n.lower() for n in names}).orderBy("seq").collect()
    finally:
        spark.conf.unset(name)
    want = list(by_hand(text, {n.lower() for n in names}))
    assert [(r.company, r.year, r.coder, r.sentence) for r in rows] == want and len(want) > 30


def test_other_files(spark, tmp_path):
    (tmp_path / "kw.txt").write_text("ai\n\n ml \nai\n")
    assert files.read_keywords(spark, str(tmp_path / "kw.txt")) == ["ai", "ml", "ai"]
    (tmp_path / "tax.csv").write_text('k,c,s,d\nRisk,Legal,IP;,"a ""b"""\nRisk,,IP,x\n')
    assert [tuple(r) for r in files.read_taxonomy(spark, str(tmp_path / "tax.csv")).collect()] == [("Risk", "Legal", "IP", 'a "b"')]
    (tmp_path / "r.csv").write_text("Level 2: avg,why\nnone,x\n")
    assert [tuple(r) for r in files.read_rubric(spark, str(tmp_path / "r.csv")).collect()] == [(2, "why")]
    (tmp_path / "a.csv").write_text("What human coders know,\nFirst\n")
    assert [r.assumption for r in files.read_assumptions(spark, str(tmp_path / "a.csv")).collect()] == ["First"]
    (tmp_path / "f1.csv").write_text("anchor_id,decision,who\ns-1,Human Miss,x\n,Human Miss,y\n")
    (tmp_path / "f2.csv").write_text("decision,anchor_id,explanation\nok,s-2,e\n")
    rows = files.read_feedback(spark, [str(tmp_path / "f1.csv"), str(tmp_path / "f2.csv")], {"who": "reviewer"}).orderBy("anchor_id").collect()
    assert [(r.reviewer, r.anchor_id, r.explanation) for r in rows] == [("x", "s-1", ""), ("", "s-2", "e")]
    (tmp_path / "acme_2024.htm").write_text("<p>Hi</p>")
    (tmp_path / "other.htm").write_text("x")
    docs = files.read_html(spark, str(tmp_path / "*.htm"))
    assert [tuple(r) for r in files.extracted(docs).collect()] == [("acme_2024", "Hi")]
    human = spark.createDataFrame([("acme", 2024)], "company_slug string, year int")
    runs = spark.createDataFrame([("acme_2024", "b"), ("acme_2024", "a")], "doc_id string, version_id string")
    r = files.discover(docs, human, runs).first()
    assert (r.has_human, r.has_ai, r.versions) == (True, True, ["a", "b"])
    line = ["0007" if c == "cik" else "2" if t in ("int", "bigint") else "true" if t == "boolean" else "" for c in files.EXPORT for t in [files.EXPORT_TYPES.get(c, "string")]]
    (tmp_path / "e.csv").write_text(",".join(files.EXPORT) + "\n" + ",".join(line) + "\n")
    e = files.read_export(spark, str(tmp_path / "e.csv")).first()
    assert (e.cik, e.year, e.disputed, e.resolved_at, e.note) == ("0007", 2, True, None, None)


def corpus(spark):
    return spark.createDataFrame([(1, "We face legal risk. We run a board. Nothing here."), (2, "A legal risk. A legal risk. Fine.")], "doc_id long, text string")


RULES = [("legal", "Risk", "Legal", "IP", None), ("board", "Risk Mitigation", "Governance", "Board", 2), ("fine", "Risk", "Nowhere", "IP", None)]
TAX = [("Risk", "Legal", "IP", ""), ("Risk Mitigation", "Governance", "Board", "")]


def test_a_whole_run(spark, tmp_path):
    tax = spark.createDataFrame(TAX, files.TAXONOMY)
    human = spark.createDataFrame([(1, "A", "x", "We run a board.", "Risk Mitigation", "Board", 2)], "doc_id long, coder string, coder_name string, sentence string, kind string, subcategory string, strength int")
    for name in ("baseline", "n_sentence_chunk_20", "keyword_window_20"):
        run = lifecycle.run_strategy(corpus(spark), strategies.get_strategy(name), annotators.RuleAnnotator(RULES), tax, ["legal", "board"], human=human)
        assert sorted((r.doc_id, r.sentence, r.kind, r.strength) for r in run.annotations.collect()) == [
            (1, "We face legal risk.", "Risk", None), (1, "We run a board.", "Risk Mitigation", 2), (2, "A legal risk.", "Risk", None)]
        assert {r.doc_id: r.anchors_with_ai_and_human for r in run.counts.collect()}[1] == 1
    assert len(strategies.STRATEGIES) == 10
    assert lifecycle.missing(corpus(spark), spark.createDataFrame([(1, "v")], "doc_id long, version_id string"), "v").count() == 1


def test_replies_are_asked_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def call(prompt, text):
        asked.add(1)
        if "bad" in text:
            raise RuntimeError
        return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps({"annotations": [{"sentence": text}]})}}]})

    chunks = spark.createDataFrame([(1, "chunk_0000", "a"), (1, "chunk_0001", "bad")], "doc_id long, chunk_id string, text string")
    caller = annotators.CallAnnotator(call)
    parsed = annotators.parse_reply(annotators.annotate_cached(caller, chunks, "p", "v", str(tmp_path)))
    assert sorted((r.chunk_id, r.status) for r in parsed.collect()) == [("chunk_0000", "ok"), ("chunk_0001", "empty")]
    before = asked.value
    assert annotators.annotate_cached(caller, chunks, "p", "v", str(tmp_path)).count() == 2
    assert asked.value == before


def test_a_run_that_is_cut_off_goes_on_behind_its_last_part(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "chunk_0000", f"t{i}") for i in range(40)], "doc_id long, chunk_id string, text string")

    class Breaks(annotators.RuleAnnotator):
        asked, left = [], 2

        def annotate(self, chunks, prompt=""):
            if self.left == 0:
                raise RuntimeError
            self.left -= 1
            self.asked.append({r.doc_id for r in chunks.collect()})
            return super().annotate(chunks, prompt)

    rules = Breaks(RULES)
    with pytest.raises(RuntimeError):
        annotators.annotate_cached(rules, chunks, "p", "v", str(tmp_path), parts=4)
    rules.left = 9
    assert annotators.annotate_cached(rules, chunks, "p", "v", str(tmp_path), parts=4).count() == 40
    first, second, *rest = rules.asked
    assert first and second and sum(map(len, rules.asked)) == 40 and not (first | second) & set().union(*rest)


def test_items_of_cut_and_odd_answers(spark):
    whole = '{"annotations": [{"sentence": "a \\"{x}\\"", "kind": "Risk", "strength": "2"}, {"sentence": 7, "strength": "high", "odd": {"deep": "}"}}, {"kind": null}, {}, {"sentence": "cut", "odd": {"deep": 1}, "ki'
    raw = lambda reason, content: json.dumps({"choices": [{"finish_reason": reason, "message": {"content": content}}]})
    rows = [(1, raw("length", whole)), (2, raw("stop", "no json")), (3, None), (4, raw("stop", "")), (5, "{broken")]
    found = {r.i: r for r in annotators.reply_items(spark.createDataFrame(rows, "i int, raw_response string")).collect()}
    assert [found[i].status for i in range(1, 6)] == ["truncated", "ok", "empty", "empty", "empty"]
    items = found[1]["items"]
    assert items[0].sentence == 'a "{x}"' and items[0].strength == 2 and items[0].extra == []
    assert items[1].sentence == "7" and items[1].strength is None and [x.extra for x in items] == [[], ["odd"], []] and not any(found[i]["items"] for i in (2, 3, 4, 5))


def test_prompts(spark):
    tax = spark.createDataFrame(TAX, files.TAXONOMY)
    text = prompts.system_prompt(tax, rules="Be strict.", reasoned=True)
    assert "| Legal | IP |" in text and "Be strict." in text and "reasoning" in text
    s = spark.createDataFrame([(1, 1, "s-00001", "b"), (1, 0, "s-00000", "a")], "doc_id long, sentence_idx int, anchor_id string, text string")
    assert prompts.numbered(s).first().text == "[s-00000] a\n[s-00001] b"


def test_tables_and_meta(spark, tmp_path):
    rows = spark.createDataFrame([(1, "v1"), (2, "v2")], "doc_id long, version_id string")
    sinks.write_table(rows, str(tmp_path), "t")
    sinks.write_table(rows.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")), str(tmp_path), "t")
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 9]
    sinks.append_meta(spark, str(tmp_path), doc_id="d", version_id="v", n_chunks=3, chunker_params={"n": "2"})
    assert spark.read.parquet(f"{tmp_path}/run_meta").first().created_at is not None


def test_arriving_documents(spark, tmp_path):
    corpus(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        incremental.stream_hits(stream, ["legal"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    done = corpus(spark).where("doc_id = 1").withColumn("content_hash", incremental.content_hash())
    assert [r.doc_id for r in incremental.new_content(corpus(spark), done).collect()] == [2]


def test_stream_without_repeats(spark, tmp_path):
    rows = [(i, f"text {i % 4}", f"2024-01-01 00:{i:02d}:00") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(f"{tmp_path}/in")
    once = incremental.dedupe_stream(stream, "ts")
    once.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [f"text {i}" for i in range(4)]


def test_phases_are_asked_about_what_was_kept(spark, tmp_path):
    """Replies are kept by phase: each phase has one reply a document, its text only what the phase before kept."""
    from marginalia.plans.workflows import Phases, sequential

    tax = spark.createDataFrame(TAX, files.TAXONOMY)
    texts = {}

    class Seen(annotators.PhaseRules):
        def annotate(self, chunks, prompt=""):
            for r in chunks.collect():
                texts[r.chunk_id, r.doc_id] = r.text
            return super().annotate(chunks, prompt)

    rules = Seen([("legal", "Risk", "Legal", "IP", None), ("board", "Risk Mitigation", "Governance", "Board", 2)], about="risk|board|fine", passage="risk", idle="none")
    docs = corpus(spark)
    run = lifecycle.run_strategy(docs, strategies.get_strategy("sequential_batched"), rules, tax, folder=str(tmp_path))
    assert sorted((r.doc_id, r.kind, r.strength) for r in run.annotations.collect()) == [(1, "Risk", None), (1, "Risk Mitigation", 2), (2, "Risk", None)]
    assert texts["p2_kind", 1] == "[s-00000] We face legal risk.\n[s-00001] We run a board."
    assert texts["p3b_mit_cats", 1] == "[s-00001] We run a board." and ("p3b_mit_cats", 2) not in texts
    before = len(texts)
    texts.clear()
    again = sequential(run.sentences, Phases(rules, tax, folder=str(tmp_path), version="sequential_batched"))
    assert again.count() == 4 and not texts and before
    assert "Governance" in prompts.phase_prompt("p3b_mit_cats", tax) and "Legal" not in prompts.phase_prompt("p3b_mit_cats", tax)
    answer = prompts.answer_schema(tax)["properties"]["annotations"]["items"]["properties"]
    assert answer["category"]["enum"] == ["Governance", "Legal"] and answer["strength"]["enum"] == [1, 2, 3, None]


def test_workflows_hold_whatever_the_replies_say(spark):
    """Unknown, repeated and foreign anchors, reversed and overlapping passages, nulls: the same as the operators by rows make of these verdicts."""
    from marginalia.operators import phases
    from marginalia.plans.workflows import WORKFLOWS, Phases

    n, a = 8, lambda i: f"s-{i:05d}"
    verdicts = {
        "p1_candidates": [{"anchor_id": x} for x in (a(1), a(3), a(3), a(2), "s-3", a(50), None, a(0))],
        "p1_passages": [{"start_anchor": x, "end_anchor": y, "topic_summary": t} for x, y, t in ((a(3), a(1), "one"), (a(2), a(4), "two"), (a(6), a(60), "out"), (a(4), a(4), None), ("x", a(1), "bad"))],
        "p2_outside_mentions": [{"anchor_id": x} for x in (a(6), a(2), a(6), a(77))],
        "p3_context_filter": [{"anchor_id": x, "keep": k, "reason": "r"} for x, k in ((a(1), True), (a(2), False), (a(2), True), (a(6), True), (a(3), None), (a(7), True), (a(4), True))],
        "kind": [{"anchor_id": x, "kind": k} for x, k in ((a(1), "Risk"), (a(2), "Risk Mitigation"), (a(3), "Risk Mitigation"), (a(3), "Risk"), (a(6), "Risk Mitigation"), (a(7), "Risk"), (a(0), None), (a(4), "Odd"))],
        "risk": [{"anchor_id": x, "category": c, "subcategory": "s"} for x, c in ((a(3), "c1"), (a(1), "c2"), (a(1), "c3"), (a(2), "c4"), (None, "c5"))],
        "mit": [{"anchor_id": x, "category": c, "subcategory": None} for x, c in ((a(2), "m1"), (a(6), "m2"), (a(3), "m3"), (a(1), "m4"))],
        "strength": [{"anchor_id": x, "strength": v} for x, v in ((a(2), 1), (a(2), 3), (a(6), None), (a(1), 2))],
    }
    of = {"p2_kind": "kind", "p4_kind": "kind", "p3a_risk_cats": "risk", "p5a_risk_cats": "risk", "p3b_mit_cats": "mit", "p5b_mit_cats": "mit", "p4_strength": "strength", "p6_strength": "strength"}

    class Scripted(annotators.Annotator):
        def annotate(self, chunks, prompt):
            raw = {p: json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps({"passages" if p == "p1_passages" else "verdicts": verdicts[of.get(p, p)]})}}]}) for p in prompts.PHASES}
            return chunks.select("doc_id", "chunk_id", F.element_at(F.create_map(*(F.lit(x) for kv in raw.items() for x in kv)), F.col("chunk_id")).alias("raw_response"))

    s = spark.createDataFrame([(d, i, a(i), f"text {i}") for d in (1, 2) for i in range(n)], "doc_id long, sentence_idx int, anchor_id string, text string")

    def table(name, kinds):
        rows = [(d, k, *v.values()) for d in (1, 2) for k, v in enumerate(verdicts[name])]
        return spark.createDataFrame(rows, "doc_id long, seq int, " + kinds)

    anchor = "anchor_id string"
    later = [table("kind", f"{anchor}, kind string"), *(table(x, f"{anchor}, category string, subcategory string") for x in ("risk", "mit")), table("strength", f"{anchor}, strength int")]
    passages = table("p1_passages", "start_anchor string, end_anchor string, topic_summary string").withColumnRenamed("seq", "passage")
    want = {
        "sequential": phases.sequential(s, table("p1_candidates", anchor), *later),
        "passage_aware": phases.passage_aware(s, passages, table("p2_outside_mentions", anchor), table("p3_context_filter", f"{anchor}, keep boolean, reason string"), *later),
    }
    for name, rows in want.items():
        got = WORKFLOWS[name](s, Phases(Scripted(), spark.createDataFrame(TAX, files.TAXONOMY)))
        assert sorted(map(repr, (tuple(r) for r in got.select(*rows.columns).collect()))) == sorted(map(repr, (tuple(r) for r in rows.collect())))
        assert got.count()


def test_a_workflow_by_rules_shuffles_no_text(spark):
    from marginalia.operators.sentences import sentence_arrays
    from marginalia.plans.workflows import Phases, passage_aware

    rules = annotators.PhaseRules(RULES, about="risk|board", passage="risk", idle="none")
    rows = passage_aware(sentence_arrays(corpus(spark)), Phases(rules, spark.createDataFrame(TAX, files.TAXONOMY)))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count()


def test_places_of_annotations_do_not_run_into_the_next_chunk(spark):
    parsed = spark.createDataFrame([(1, f"chunk_{k:04d}", [(f"t{k}-{i}",) for i in (0, 1)]) for k in (2, 1, 0)], "doc_id long, chunk_id string, a array<struct<sentence:string>>")
    parsed = parsed.select("doc_id", "chunk_id", F.struct(F.transform("a", lambda x: x).alias("annotations")).alias("answer"))
    rows = annotators.annotations_of(parsed).orderBy("seq").collect()
    assert [r.sentence for r in rows] == ["t0-0", "t0-1", "t1-0", "t1-1", "t2-0", "t2-1"] and rows[2].seq == 1 << 31


def test_listing_pages_takes_no_task_for_each_folder(spark, tmp_path):
    """A hundred pages in folders of their own, as html_files writes them: few tasks list them, and the session's setting stays."""
    from marginalia.sources.files import read_html

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(100):
        (tmp_path / f"file=acme_{2000 + i}.htm").mkdir()
        (tmp_path / f"file=acme_{2000 + i}.htm" / "part-0.txt").write_text(f"<p>{i}\n</p>")
    before, sc = spark.conf.get(key), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    rows = read_html(spark, str(tmp_path))
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and all(tracker.getStageInfo(int(s)).numTasks <= 4 * sc.defaultParallelism for s in stages)
    assert spark.conf.get(key) == before
    assert {(r.doc_id, r.html) for r in rows.collect()} == {(f"acme_{2000 + i}", f"<p>{i}\n</p>") for i in range(100)}
