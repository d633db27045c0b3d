import zlib

import numpy as np
import pytest

from marginalia.llm import labelled, quality, toxicity


def numeric_check(model, loss, grads, names, rng):
    for name in names:
        w = model.w[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            old, h = w[at], 1e-3
            w[at] = old + h
            up = loss()
            w[at] = old - h
            down = loss()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * h), abs=3e-3)


def cross_entropy(z, y):
    return float(np.mean(np.logaddexp(0, z) - y * z))


def test_quality_gradients():
    rng, model, features = np.random.default_rng(0), quality.Model(), quality.Features()
    texts = ["One two three. " * 30, "A!! B!! C!!", "", "x " * 120]
    batch, y = features.passages(texts), np.array([1, 0, 1, 0], dtype=np.float32)
    grads = model.gradients(*batch, y)
    numeric_check(model, lambda: cross_entropy(model.forward(*batch)["y"], y), grads, ["H", "V", "U", "a", "o", "b"], rng)


def test_toxicity_gradients():
    rng, model = np.random.default_rng(1), toxicity.Model()
    model.w = {k: (0.5 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in model.w.items()}
    model.w["E"][0] = 0
    ids, y = [np.array([5, 9, 5, 77, 3]), np.array([4]), np.array([], np.int64), rng.integers(1, 50, 40)], np.array([1, 0, 1, 0], np.float32)
    grads = model.gradients(ids, y)

    def loss():
        return cross_entropy(model.logits(model.features(ids)), y)

    rows, values = grads.pop("E")
    numeric_check(model, loss, grads, list(grads), rng)
    for row, value in zip(rows, values):
        for e in (0, 5):
            old, h = model.w["E"][row, e], 1e-4
            model.w["E"][row, e] = old + h
            up = loss()
            model.w["E"][row, e] = old - h
            down = loss()
            model.w["E"][row, e] = old
            assert row == 0 or value[e] == pytest.approx((up - down) / (2 * h), abs=2e-3)


def test_toxicity_forward_equals_brute_force():
    """One window and one filter at a time."""
    rng, model = np.random.default_rng(2), toxicity.Model()
    model.w = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in model.w.items()}
    model.w["E"][0] = 0
    ids = [rng.integers(1, 1000, n) for n in (1, 2, 7, 30)] + [np.array([], np.int64)]
    got = model.logits(model.features(ids))
    for x, z in zip(ids, got):
        words = [*(model.w["E"][r] for r in x)] or [np.zeros(toxicity.EMBEDDING)]
        padded, total, col = [*words, np.zeros(toxicity.EMBEDDING), np.zeros(toxicity.EMBEDDING)], float(model.w["b"][0]), 0
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(sum(padded[at + j] @ model.w["K"][:, (col + j) * toxicity.FILTERS + f] for j in range(width)) for at in range(len(words)))
                total += max(0.0, best + model.w["c"][i * toxicity.FILTERS + f]) * model.w["o"][i * toxicity.FILTERS + f]
            col += width
        assert z == pytest.approx(total, abs=1e-3)


def test_every_bucket_has_an_embedding_of_its_own():
    model = toxicity.Model().fit([f"word{i} other{i % 7} third{i % 5}" for i in range(200)], np.arange(200) % 2, 0.5)
    assert len(model.w["E"]) == 1 + 2 * toxicity.BUCKETS
    words = toxicity.Words(model.telling)
    assert words.of(b"neverseen") == 1 + toxicity.pieces_of(b"neverseen")[0]


def test_quality_forward_equals_brute_force():
    model, features = quality.Model(), quality.Features()
    texts = ["One two three. " * 40, "A!! b", ""]
    got = model.forward(*features.passages(texts))["y"]
    w, sig = model.w, lambda x: 1 / (1 + np.exp(-x))
    for text, z in zip(texts, got):
        buckets, first, counts, _ = features.passages([text])
        hs, es = [], []
        for k, at in enumerate(first):
            to = first[k + 1] if k + 1 < len(first) else len(buckets)
            h = np.tanh(np.concatenate([w["E"][buckets[at:to]].mean(0), counts[k]]) @ w["H"])
            hs.append(h)
            es.append((np.tanh(h @ w["V"]) * sig(h @ w["U"])) @ w["a"])
        a = np.exp(es) / np.exp(es).sum()
        assert z == pytest.approx(float((a[:, None] * np.array(hs)).sum(0) @ w["o"] + w["b"][0]), abs=1e-4)


def test_sample_is_bounded_in_rows_and_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(i, "z" * 100) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 1)], "doc_id long, toxic int")
    rows, _ = labelled.training_sample(docs, labels, "toxic", 10)
    assert len({r[0] for r in rows}) == len(rows) <= 20
    monkeypatch.setattr(labelled, "SAMPLE_CHARS", 750)
    assert sum(len(r[1]) for r in labelled.training_sample(docs, labels, "toxic", 10)[0]) <= 750


def test_attention_sums_to_one():
    model, features = quality.Model(), quality.Features()
    f = model.forward(*features.passages(["a b c " * 100, "", "z"]))
    assert np.allclose(np.bincount(f["bag"], f["att"]), 1)


def test_joined_batches_equal_one_batch():
    features, texts = quality.Features(), ["a b " * 80, "", "C!! d"]
    one, many = features.passages(texts), quality.joined([features.passages([t]) for t in texts])
    for a, b in zip(one, many, strict=True):
        assert np.allclose(a, b)


def test_toxicity_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    words = ["ba", "do", "idiot", "ka", "worthless", "mi"]
    texts = [" ".join(rng.choice(words[:2] + words[3:4] + words[5:], 30)) + (" idiot worthless" if i % 3 == 0 else "") for i in range(90)]
    y = np.array([i % 3 == 0 for i in range(90)], dtype=np.float32)
    model = toxicity.Model().fit(texts, y, 1 / 3)
    w = toxicity.Words(model.telling)
    together = model.scores(w, texts)
    alone = np.concatenate([model.scores(w, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert ((together >= 0.5) == (y == 1)).all()
    assert model.scores(w, ["", " "]).shape == (2,)


def test_folds_are_the_crc_of_the_id(spark):
    df = spark.createDataFrame([(i,) for i in range(-3, 60)] + [(None,)], "doc_id long")
    for r in df.withColumn("h", labelled.held_out()).collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.h == (zlib.crc32(text.encode()) % 4 == 2)


def frame(spark, n=400):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(["alba", "bene", "cura", "dona", "esca"], 60))
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            words[10:12] = ["vile", "scumbag"]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = frame(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    good = quality.score_quality(docs, labels).where("held_out").collect()
    assert len(good) > 50 and np.mean([(r.score >= 0.7) == truth[r.doc_id].quality for r in good]) > 0.97
    bad = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id].toxic for r in bad]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.score_quality(docs, labels).where("score >= 0.7").collect()}


def test_odd_rows_and_empty_tables(odd, empty, labels):
    nothing = labels.where("false")
    for table, marks in ((odd, labels), (odd, nothing), (empty, labels)):
        for found in (quality.score_quality(table, marks), toxicity.score_toxicity(table, marks)):
            rows = found.collect()
            assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality.keep_good(table, marks).columns == table.columns


def test_cuts_come_from_all_labelled_training_rows(spark):
    """The network is fitted on a few rows; a language's cut maximises F1 over all of its training rows but those."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(1200):
        words, toxic = list(rng.choice(["alba", "bene", "cura", "dona", "esca"], 30)), i % 12 == 0
        if toxic or i % 9 == 0:  # many clean documents hold the word too
            words[7] = "vile"
        rows.append((i, " ".join(words), "de" if i % 30 == 1 or i % 24 == 0 else "en"))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, per_class=20).collect()}
    truth, lang = dict(marks), {i: x for i, _, x in rows}

    def best(pick):
        s, t = np.array([found[i].score for i in pick]), np.array([truth[i] for i in pick])
        f1 = np.array([2 * (t * (s >= c)).sum() / max(1, t.sum() + (s >= c).sum()) for c in toxicity.GRID])
        top = toxicity.GRID[np.isclose(f1, f1.max())]
        return top[np.argmin(np.abs(top - toxicity.CUT))]

    used = {r[0] for r in labelled.training_sample(docs, labels, "toxic", 20, spare=True)[0]}
    train = [i for i in found if not found[i].held_out and i not in used]
    assert 0 < len(used) <= 40
    for name in ("de", "en"):
        own = [i for i in train if lang[i] == name]
        want = (len(own) * best(own) + toxicity.SHRINK * best(train)) / (len(own) + toxicity.SHRINK)
        assert {round(found[i].lang_cut, 9) for i in found if lang[i] == name} == {round(want, 9)}
