"""Queries where the package is not installed for the workers, and stages on odd, clashing and empty tables."""

import os
import subprocess
import sys
import textwrap
from hashlib import sha256
from pathlib import Path

import pyspark
import pytest

import corpus_pipeline
from marginalia.llm import exact_dedup, mixing, queries, simhash

REPO = Path(__file__).resolve().parents[2]
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, _id string, _kid string, _gone_id string, _mix_row string, _mix_pid int, _kdigest_own string, _own_digest string"


def clashing(spark, n=60):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i % 50, f"{base} {i % 40}" if i % 7 else None, "en", f"s{i % 3}", 9) + ("c",) * 4 + (7, "k", "o") for i in range(n)]
    return spark.createDataFrame(rows, CLASHES)


def test_stages_keep_clashing_columns(spark):
    docs = clashing(spark)
    for stage in (exact_dedup.drop_duplicates, simhash.keep_one_per_group, mixing.mixed_documents):
        found = stage(docs)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all((r._kid, r._gone_id, r._mix_row, r._mix_pid, r._kdigest_own, r._own_digest) == ("c", "c", "c", 7, "k", "o") for r in rows)


def test_dropped_rows_are_the_marked_ones(spark, monkeypatch):
    """By broadcast and by shuffle alike; of rows that repeat id and text one stays."""
    from marginalia.llm import shared

    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, None), (3, ""), (4, "b"), (4, "b"), (4, "c"), (None, "z")], "doc_id long, text string")
    want = sorted([("2", "a"), ("3", ""), ("4", "b"), ("4", "c"), ("None", "z")])
    for limit in (shared.SMALL_SIDE, -1):
        monkeypatch.setattr(shared, "SMALL_SIDE", limit)
        assert sorted((str(r.doc_id), r.text or "") for r in exact_dedup.drop_duplicates(docs).collect()) == want


def test_hot_keys_give_the_same_join(spark, monkeypatch):
    from marginalia.llm import shared

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(900)], "i long, k string")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "concat(k, '!') as v")
    want = sorted((r.i, r.k, r.v) for r in rows.join(table.drop("n"), "k").collect())
    for heavy in (1, 64, 10_000):
        monkeypatch.setattr(shared, "HEAVY_ROWS", heavy)
        assert sorted((r.i, r.k, r.v) for r in shared.joined_by_key(rows, table, "k", "n").collect()) == want


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rows_that_repeat_an_id_have_their_own_plan(spark):
    """Shares and mixed documents agree by source and row, where rows repeat ids, and a third of all rows is one row."""
    from collections import Counter

    rows = [(i % 20, " ".join(f"{'ab'[i % 2]}{i}x{k}" for k in range(30)), "AB"[i % 2], 0) for i in range(400)]
    rows += [(7, " ".join(f"c{k}" for k in range(30)), "C", 0)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    mix = mixing.Mix(docs)
    shares = mix.shares().collect()
    assert len(shares) == len(rows) and {r.source_size for r in shares} == {6000}  # three sources of 200 rows of 30 words
    goal = {r.target for r in shares}
    assert sum(goal) == pytest.approx(18000) and all(g <= 3 * 6000 for g in goal)
    taken, by_text = Counter(), Counter()
    for r in mixing.mixed_documents(docs).collect():
        found = words_of(r.text)
        assert found and all(w[0] == {"A": "a", "B": "b", "C": "c"}[r.source] for w in found)
        taken[r.source] += len(found)
        by_text.update((r.doc_id, r.source, w) for w in found)
    assert len(goal) == 3 and sorted(taken.values()) == pytest.approx(sorted(goal), rel=0.05)
    assert sum(taken.values()) == pytest.approx(sum(r.taken for r in shares), rel=0.02)
    assert max(by_text.values()) <= 3 * 200  # no word of a row more than three times, also where 200 rows have it


def test_stages_in_sequence_on_odd_and_empty_tables(spark, odd, empty, labels, tmp_path):
    """Each stage's rows against what it says of its own input."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, empty):
        docs, kept = table, table.collect()
        for _name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            was, kept = kept, docs.collect()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert docs.columns == before.columns
            if stage is corpus_pipeline.keep_good_documents:
                assert {r.doc_id for r in kept} <= {r.doc_id for r in was} and (not was or len(kept) >= 1)
            elif stage is corpus_pipeline.drop_exact_copies:
                assert sorted(r.text or "" for r in kept) == sorted({r.text or "" for r in was})
            elif stage is corpus_pipeline.drop_near_copies:
                assert {r.text or "" for r in kept} <= {r.text or "" for r in was} and (not was or len(kept) >= 1)
            elif stage is corpus_pipeline.mix_sources:
                assert {(r.doc_id, r.source) for r in kept} <= {(r.doc_id, r.source) for r in was}
                assert all(set(words_of(r.text)) <= {w for x in was if x.doc_id == r.doc_id for w in words_of(x.text)} for r in kept)
            else:
                assert len(kept) == len(was) and all(r.n_tokens == len(r.ids) for r in kept)
                assert sorted(r.decoded_sha256 for r in kept) == sorted(sha256((r.text or "").encode()).hexdigest() for r in was)
        assert (len(kept) > 0) == (table is odd)


def test_queries_of_the_entry_have_their_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    secrets = queries.op10_secret_scan(spark, sf).collect()
    spans = {r.doc_id: r.spans.split(",") for r in secrets}
    for r in secrets:
        kinds = [s.split(":")[0] for s in spans[r.doc_id]]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
    for query, cut in ((queries.op2_toxicity, 0.3), (queries.op5_quality, 0.7)):
        rows = query(spark, sf).collect()
        assert len(rows) == docs.count() and all(r.predicted == int(r.score >= cut) for r in rows)


def test_workers_need_no_package(tmp_path):
    """All queries in a fresh process outside of the repository, whose workers cannot import the package."""
    home = tmp_path / "home"  # workers make a folder in Spark's home, which may not be ours to write
    (home / "work").mkdir(parents=True)
    for item in Path(pyspark.__file__).parent.iterdir():
        if item.name != "work":
            (home / item.name).symlink_to(item)
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1500m")
                 .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        import __spark_entry__
        seen = __spark_entry__.queries()
        for name in [n for n in seen if n.startswith("op")] + ["pipeline"]:
            print("ROWS", name, seen[name](spark, "/root/testdata/sf0.001").count(), flush=True)
        def has(_):
            import importlib.util
            yield importlib.util.find_spec("marginalia") is not None
        print("HAS", spark.sparkContext.parallelize([1], 1).mapPartitions(has).collect())
        spark.stop()
    """))  # fmt: skip
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run(["timeout", "900", sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True)
    rows = [x.split() for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert len(rows) == 14 and all(int(n) > 0 for _, _, n in rows), done.stderr[-3000:]
    assert "HAS [False]" in done.stdout
