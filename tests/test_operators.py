import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import agreement, align, annotations, chunks, diagnose, evaluate, feedback, keywords, phases, render, report

TAXONOMY = [("Risk", "Legal", "Other"), ("Risk", "Legal", "IP"), ("Risk", "Competitive", "Other"), ("Risk Mitigation", "Governance", "Board")]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "kind string, category string, subcategory string")


def sentence_table(spark, counts, text=lambda d, i: f"t{i}"):
    rows = [(d, i, f"s-{i:05d}", text(d, i), 0, 0) for d, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, sentence_idx int, anchor_id string, text string, char_start int, char_end int")


def test_keyword_hits(spark):
    s = spark.createDataFrame([("d", 0, "s-00000", "We maintain AI and ai, Generative AI."), ("d", 1, "s-00001", "No."), ("d", 2, "s-00002", "A.I. or AI/ML é É")], "doc_id string, sentence_idx int, anchor_id string, text string")
    hits = {r.sentence_idx: r.matched_terms for r in keywords.find_hits(s, ["AI", "generative ai", "A.I.", "AI/ML", "AI", "é"]).collect()}
    assert hits == {0: ["ai", "AI", "Generative AI"], 2: ["A.I.", "AI/ML", "é", "É"]}
    assert [r.matched_terms for r in keywords.find_hits(s, ["AI"], word_boundary=True).collect()][0] == ["AI", "ai"]
    assert keywords.find_hits(s, [" "]).count() == 0


def test_cached_hits_belong_to_their_vocabulary(spark, tmp_path):
    s = sentence_table(spark, {1: 3})
    assert keywords.cached_hits(s, ["t1"], str(tmp_path)).count() == 1
    assert keywords.cached_hits(s, ["t"], str(tmp_path)).count() == 3
    assert keywords.cached_hits(s.where("false"), ["t"], str(tmp_path)).count() == 3


def test_windows_equal_a_loop(spark):
    rng = random.Random(0)
    counts = {d: rng.randrange(1, 40) for d in range(60)}
    marks = {d: sorted(rng.sample(range(n), rng.randrange(0, min(n, 8)))) for d, n in counts.items()}
    s = sentence_table(spark, counts)
    hits = spark.createDataFrame([(d, i) for d, x in marks.items() for i in x], "doc_id long, sentence_idx int")
    for w in (0, 1, 3):
        want = []
        for d, x in marks.items():
            spans = []
            for i in x:
                lo, hi = max(0, i - w), min(counts[d] - 1, i + w)
                if spans and lo <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            want += [(d, k, lo, hi) for k, (lo, hi) in enumerate(spans)]
        assert sorted(map(tuple, chunks.keyword_window(s, hits, w).collect())) == sorted(want)


def test_blocks_equal_a_loop(spark):
    counts = {d: d for d in range(1, 25)}
    s = sentence_table(spark, counts)
    for n, stride in ((1, 1), (5, 5), (7, 3), (3, 8), (40, 2)):
        want = []
        for d, total in counts.items():
            start = k = 0
            while start < total:
                end = min(total, start + n)
                want.append((d, k, start, end - 1))
                k, start = k + 1, start + stride
                if end == total:
                    break
        assert sorted(map(tuple, chunks.n_sentence(s, n_sentences=n, stride=stride).collect())) == sorted(want)
    assert chunks.n_sentence(s, n_sentences=0).count() == 0
    with pytest.raises(KeyError):
        chunks.chunk_ranges("none such", s)


def test_dedupe_and_validation(spark, taxonomy):
    rows = [
        (1, "It’s  x", "Risk", "Legal", "IP", 2), (2, "it's x", "Risk", "Legal", "IP", 2), (3, "it's x", "Risk", "Legal", "IP", None), (4, "a", "Bad", "Legal", "IP", None),
        (5, "b", "Risk Mitigation", "Governance", "Board", 0), (6, "b", "Risk Mitigation", "Legal", "Board", 1), (7, "c", "Risk", "Governance", "IP", None),
        (8, "d", "Risk", "Legal", "none", None), (9, "e", "Risk Mitigation", "Governance", "Board", 3), (10, "f", None, "Legal", "IP", None), (11, "g", "Risk", "Legal", "Board", None),
    ]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, seq long, sentence string, kind string, category string, subcategory string, strength int")
    unique = annotations.dedupe_annotations(df)
    assert sorted(r.seq for r in unique.collect()) == [1, *range(3, 12)]
    valid, counts = annotations.validate_annotations(unique, taxonomy)
    assert {r.reason: r.n for r in counts.collect()} == {"kept": 4, "dropped_bad_kind": 2, "dropped_bad_strength": 1, "dropped_unknown_category": 2, "dropped_unknown_subcategory": 1}
    assert sorted((r.seq, r.strength) for r in valid.collect() if r.seq < 9) == [(1, None), (3, None)]
    assert sorted(r.seq for r in annotations.validate_annotations(unique, taxonomy, strict=True)[0].collect()) == [1, 3, 9]


@pytest.mark.parametrize("whole", [False, True])
def test_an_automaton_finds_what_an_alternation_finds(spark, whole):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAB é-") for _ in range(n))
    terms = [word(rng.randrange(1, 6)) for _ in range(60)] + ["ab", "abab", "b.a", "(a", "É b", " "]
    texts = [word(rng.randrange(0, 80)) for _ in range(200)] + [None, "", "b.a (A (ab) é B"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.x, r.y or []) for r in df.select("i", keywords.automaton_terms(F.col("t"), terms, whole).alias("x"), keywords.matched_terms(F.col("t"), terms, whole).alias("y")).collect()}
    assert all(x == y for x, y in got.values()) and any(x for x, _ in got.values())


def test_many_terms_take_the_automaton(spark):
    s = sentence_table(spark, {1: 3}, lambda d, i: ["Term77 and term7", "nothing", "a TERM99999 b"][i])
    hits = keywords.find_hits(s, [f"term{i}" for i in range(100_000)])
    assert {r.sentence_idx: r.matched_terms for r in hits.collect()} == {0: ["Term77", "term7"], 2: ["TERM99999"]}


def brute_anchor(key, keys):
    if key in keys:
        return keys.index(key)
    if len(key) >= 80:
        for i, k in enumerate(keys):
            if k.startswith(key[:80]):
                return i
    if len(key) > 40:
        for i, k in enumerate(keys):
            if len(k) > 40 and max(len(k), len(key)) <= 1.5 * min(len(k), len(key)) and (key in k or k in key):
                return i
    return None


def test_anchors_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 6)))
    docs = {d: [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(15)] for d in range(12)}
    asked = []
    for d, keys in docs.items():
        for k in keys:
            asked += [(d, k), (d, k + " zz" * rng.randrange(1, 30)), (d, k[rng.randrange(0, 20) :]), (d, word())]
        keys.append(keys[0])
    s = sentence_table(spark, {d: len(k) for d, k in docs.items()}, lambda d, i: docs[d][i])
    q = spark.createDataFrame(asked, "doc_id long, sentence string")
    got = {(r.doc_id, r.key): r.sentence_idx for r in align.find_anchors(q, s).collect()}
    norm = lambda t: " ".join(t.split())
    for d, t in asked:
        assert got.get((d, norm(t))) == (brute_anchor(norm(t), docs[d]) if norm(t) else None)


def contained(docs, asked):
    """(document, key) -> first sentence that holds the key or lies in it, for keys that nothing else finds."""
    return {(d, k): hit for d, k in asked if (hit := brute_anchor(k, docs[d])) is not None}


@pytest.mark.parametrize("split", [4096, 3])
def test_containment_equals_brute_force_on_boilerplate(spark, monkeypatch, split):
    """Long words, shared stretches, repeats, strings within each other in both directions; grams that many strings have are dealt out."""
    monkeypatch.setattr(align, "SPLIT", split)
    rng = random.Random(19)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    stock = " ".join(word(5) for _ in range(9))
    docs = {
        0: [f"{word(3)} {stock} {word(4)} {word(6)}" for _ in range(25)] * 2, 1: [word(rng.randrange(45, 140)) for _ in range(20)],
        2: [f"{word(30)} {word(2)} {word(25)}" for _ in range(20)] + [word(28) + " " + stock], 3: [" ".join(word(rng.randrange(1, 5)) for _ in range(rng.randrange(12, 60))) for _ in range(30)],
        4: ["e\u0301" * 30 + " " + word(10) + " é😀 " + word(30)],
    }
    asked = []
    for d, keys in docs.items():
        for k in dict.fromkeys(keys):
            asked += [(d, k[a : len(k) - b].strip()) for a, b in ((2, 0), (0, 1), (3, 5), (rng.randrange(1, 15), 0))]
            asked += [(d, f"{word(2)} {k} {word(4)}"), (d, f"x{k}"), (d, stock), (d, word(50))]
    s = sentence_table(spark, {d: len(k) for d, k in docs.items()}, lambda d, i: docs[d][i])
    q = spark.createDataFrame(asked, "doc_id long, sentence string")
    got = {(r.doc_id, r.key): r.sentence_idx for r in align.find_anchors(q, s).collect()}
    assert got == contained(docs, [(d, " ".join(t.split())) for d, t in asked])


def test_repeats_of_a_sentence_are_met_once(spark):
    """2,000 copies of one sentence and 503 keys that hold it, or part of it: at most one candidate a key."""
    line = "the company may not be able to protect its rights in the systems that it uses and in the data behind them"
    s = sentence_table(spark, {1: 2000}, lambda d, i: line)
    keys = [f"{line} {i} more" for i in range(251)] + [line[i % 40 : 100] + f" q{i}"[: 3 * (i % 2)] for i in range(252)]
    left = spark.createDataFrame([(i, 1, k) for i, k in enumerate(keys)], "q long, doc_id long, key string")
    near = spark.createDataFrame([(1, 0, line)], "doc_id long, i long, k string")
    assert align._candidates(left, near).count() <= 503
    found = align.find_anchors(left.select("doc_id", F.col("key").alias("sentence")), s).collect()
    assert {r.sentence_idx for r in found} == {0} and len(found) == len({k.strip() for k in keys if brute_anchor(k.strip(), [line]) is not None})


def test_passages_as_stretches(spark):
    rng = random.Random(5)
    n, anchor = {1: 40, 2: 12, 3: 1}, lambda i: f"s-{i:05d}"
    passages = [(d, k, anchor(rng.randrange(0, n[d] + 2)), anchor(rng.randrange(0, n[d] + 2)), f"t{k}" if k % 4 else None) for d in (1, 2) for k in range(14)]
    passages += [(3, 0, "s-00000", "s-00000", "one"), (3, 1, "nowhere", "s-00000", "two"), (9, 0, "s-00000", "s-00000", "no such document"), (1, 99, None, "s-00001", "x")]
    s = sentence_table(spark, n, lambda d, i: "x")
    p = spark.createDataFrame(passages, "doc_id long, passage int, start_anchor string, end_anchor string, topic_summary string")
    want = {}
    for d, k, a, b, t in sorted(passages, key=lambda x: x[1]):
        ends = [int(x[2:]) for x in (a, b) if x and x.startswith("s-")]
        if len(ends) == 2 and d in n and max(ends) < n[d]:
            want.update({(d, i): t for i in range(min(ends), max(ends) + 1)})
    assert {(r.doc_id, r.sentence_idx): r.topic_summary for r in chunks.passage_members(p, s).collect()} == want
    stretches = chunks.passage_stretches(p, s).collect()
    assert len(stretches) <= 2 * len(passages) and sum(r.hi - r.lo + 1 for r in stretches) == len(want)


def test_resolve_and_align(spark, taxonomy):
    s = sentence_table(spark, {1: 3}, lambda d, i: ["First one.", "Second one.", "Third one."][i])
    ai = spark.createDataFrame([(1, "first ONE.", "Risk", "Legal", "IP", None), (1, "nowhere", "Risk", "Legal", "IP", None)], "doc_id long, sentence string, kind string, category string, subcategory string, strength int")
    human = spark.createDataFrame(
        [(1, "A", "x", "First one .", "Risk", "Legal; Other ;", None), (1, "B", "y", "First one.", "Risk", "IP", None), (1, "A", "x", "Third one.", "Risk", "Other", None),
         (1, "B", "y", "Second one.", "", "IP", None), (1, "B", "y", "  ", "Risk", "IP", None), (1, "B", "y", "lost", "Risk", "Competitive: Other", 2)],
        "doc_id long, coder string, coder_name string, sentence string, kind string, subcategory string, strength int")
    cards = align.align(s, ai, human, taxonomy).cache()
    found = sorted((r.side, r.coder or "", r.anchor_id or "", r.category, r.subcategory) for r in cards.collect())
    assert found == [("ai", "", "", "Legal", "IP"), ("ai", "", "s-00000", "Legal", "IP"), ("human", "A", "s-00000", "Legal", "Other"), ("human", "A", "s-00002", "(unresolved)", "Other"),
                     ("human", "B", "", "Competitive", "Other"), ("human", "B", "s-00000", "Legal", "IP")]
    c = align.align_counts(cards, human).first()
    assert (c.ai_total, c.ai_matched, c.human_total, c.human_matched, c.human_unmatched, c.human_unresolved) == (2, 1, 6, 3, 1, 1)
    assert (c.anchors_with_ai, c.anchors_with_human, c.anchors_with_both_coders, c.anchors_with_ai_and_human) == (1, 2, 1, 1)
    assert {r.anchor_id: r.source for r in align.anchor_sources(cards).collect()} == {"s-00000": "ai_and_both", "s-00002": "coder_a"}
    assert [r.anchor_id for r in diagnose.missed_anchors(cards).collect()] == ["s-00002"]
    rows = render.annotation_rows(cards, s)
    assert rows.count() == 6 and render.select_rows(rows, size=4, source=["Human"]).count() == 4
    assert report.ai_rows(cards, align.anchor_sources(cards), s).count() == 1
    assert evaluate.label_frame(cards, s, "intersection").count() == 3
    with pytest.raises(ValueError):
        evaluate.filter_coders(cards, "nobody")


def test_kappa_has_no_value_where_chance_explains_all(spark):
    cards = spark.createDataFrame([("d", "s", "human", c, "Risk", "x", "-", None, "e") for c in "AB"], "doc_id string, anchor_id string, side string, coder string, kind string, category string, subcategory string, strength int, sentence_excerpt string")
    only = spark.createDataFrame([("x",)], "category string")
    r = evaluate.coder_agreement(cards, only).first()
    assert (r.kappa, r.n_anchors, r.n_pairs, r.agreement_anchors) == (None, 1, 1, 1)
    two = spark.createDataFrame([("x",), ("y",)], "category string")
    assert evaluate.coder_agreement(cards, two).first().kappa == 1
    assert evaluate.coder_agreement(cards.where("false"), two).first().kappa is None


def test_tool_export_columns(spark):
    tags = [(1, 1, "a", [3], "Risk", "L", "o", None), (1, 2, "b", [3, 4], "Risk", "L", "o", None), (2, 3, "a", [1], "Mitigation", "G", "b", 1), (2, 4, "b", [1], "Mitigation", "G", "b", 2), (3, 5, "a", [0], "Risk", "L", "o", None)]
    df = spark.createDataFrame([(d, i, p, None, o, k, c, s, n) for d, i, p, o, k, c, s, n in tags], "doc_id long, annotation_id long, annotator string, group_id string, ordinals array<int>, kind string, category string, subcategory string, strength int")
    got = {r.annotation_id: (r.disputed, r.pair_disputed, r.strength_disputed) for r in agreement.tag_disputes(df).collect()}
    assert got == {1: (False, False, False), 2: (True, False, False), 3: (False, False, True), 4: (False, False, True), 5: (False, True, False)}
    expected = spark.createDataFrame([(3, 2)], "doc_id long, n_annotators int")
    assert {r.annotation_id: r.disputed for r in agreement.tag_disputes(df, expected).collect()}[5] is True
    res = spark.createDataFrame([(1, 4, "", False), (2, 1, "Mitigation · G · b · S2", True)], "doc_id long, ordinal int, final_tags string, is_span boolean")
    labels = {(r.doc_id, r.ordinal): (r.final_source, r.final_tags) for r in agreement.final_labels(df, res).collect()}
    assert labels == {(1, 3): ("agreed", "Risk · L · o"), (1, 4): ("resolved_to_none", ""), (2, 1): ("resolved_span", "Mitigation · G · b · S2"), (3, 0): ("solo", "Risk · L · o")}
    c = spark.createDataFrame([("Ann (2026-01-01): one | Ben (x): two",)], "c string").select(agreement.parse_comments(F.col("c"))).first()[0]
    assert [tuple(x) for x in c] == [("Ann", "2026-01-01", "one"), ("Ben", "x", "two")]


def test_passages_and_strengths(spark):
    s = sentence_table(spark, {1: 6})
    p = spark.createDataFrame([(1, 0, "s-00003", "s-00001", "back"), (1, 1, "s-00003", "s-00004", "last"), (1, 2, "s-00009", "s-00001", "gone")], "doc_id long, passage int, start_anchor string, end_anchor string, topic_summary string")
    assert {r.sentence_idx: r.topic_summary for r in chunks.passage_members(p, s).collect()} == {1: "back", 2: "back", 3: "last", 4: "last"}
    cards = spark.createDataFrame([(1, "s-00001"), (1, "s-00002")], "doc_id long, anchor_id string")
    v = spark.createDataFrame([(1, "s-00001", 1, 3), (1, "s-00001", 2, 1)], "doc_id long, anchor_id string, seq int, strength int")
    assert {r.anchor_id: r.strength for r in phases.attach_strength(cards, v).collect()} == {"s-00001": 1, "s-00002": None}
    rows = chunks.context_window(s.withColumn("line", F.col("text")), "doc_id", "sentence_idx", "line", 1, 1).orderBy("sentence_idx").collect()
    assert rows[0].context == ">> t0\n   t1" and rows[5].context == "   t4\n>> t5"


def test_few_shot(spark):
    rows = [(i, "d", f"a{i}", "Risk", "c", "s", "AI-flagged incorrectly", f"l{i % 3}", "x" * (60 + i)) for i in range(9)] + [(9, "d", "a8", "Risk", "c", "s", "AI-flagged incorrectly", "l9", "x" * 99), (10, "d", "z", "Risk", "c", "s", "Human Miss", "l", "short")]
    df = spark.createDataFrame(rows, "seq long, doc_slug string, anchor_id string, kind string, category string, subcategory string, decision string, explanation string, explanation_long string")
    assert [r.seq for r in feedback.few_shot_examples(df).orderBy("part", "rank").collect()] == [8, 7, 6, 5, 4]


def test_split_writes_one_folder_per_filing(spark, tmp_path):
    rows = spark.createDataFrame([("A B", "2024", "1", "x"), ("A B", "2024", "2", "y\nz"), ("A B", "2023", "1", 'q"q')], "company string, year string, accession string, v string")
    index = report.write_split(rows, str(tmp_path / "out"))
    assert sorted(r.path for r in index.collect()) == ["A_B/A_B_2023.csv", "A_B/A_B_2024_1.csv", "A_B/A_B_2024_2.csv"]
    assert report.index_lines(index).first().line.startswith("- **A B** — [2023](A_B/A_B_2023.csv) · [2024 (1)]")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "out"))
    assert sorted(r.v for r in back.collect()) == ['q"q', "x", "y\nz"]
    assert report.write_ai_zip(rows, str(tmp_path / "o.zip")) == 2


def test_anchors_leave_only_what_is_found_on_disk(spark):
    """Shuffle files of settled frames go at once, checkpoints that only led to the anchors with them; the session's setting stays."""
    import os
    import time

    from marginalia import scratch

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(os.path.basename, env.getAllFiles().mkString("\n").split("\n")) if f.startswith("shuffle_") and f.endswith(".data")}
    folder = scratch.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    checkpoints = lambda: {f for f in os.listdir(folder) if f.startswith("rdd-")}
    docs = {d: [f"the company {d} may not be able to protect its rights in system {i} that it uses" for i in range(20)] for d in range(5)}
    s = sentence_table(spark, {d: 20 for d in docs}, lambda d, i: docs[d][i])
    q = spark.createDataFrame([(d, t) for d, k in docs.items() for t in (k[0], k[3][4:], k[5] + " now", "none such")], "doc_id long, sentence string")
    files, kept = shuffles(), checkpoints()
    found = align.find_anchors(q, s)
    assert len(checkpoints() - kept) == 1
    for _ in range(100):  # Spark removes files in the background
        if len(shuffles() - files) <= 1:
            break
        time.sleep(0.1)
    assert len(shuffles() - files) <= 1  # how common the most common gram is: one row
    assert spark.conf.get(scratch.CLEANUP) == "false"
    assert {(r.doc_id, r.sentence_idx, r.stage) for r in found.collect()} == {(d, i, st) for d in docs for i, st in ((0, "exact"), (3, "containment"), (5, "containment"))}
