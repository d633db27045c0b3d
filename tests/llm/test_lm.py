import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import lm


def small(monkeypatch):
    for name, value in {"HEAD": 12, "WIDTH": 4, "TAIL": 3, "SIZE": 5}.items():
        monkeypatch.setattr(lm, name, value)
    monkeypatch.setattr(lm, "CLASSES", 6)


def test_gradients_through_time(monkeypatch):
    small(monkeypatch)
    rng, net = np.random.default_rng(0), lm.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    docs = [list(rng.integers(0, 15, n)) for n in (9, 4, 6, 1)]
    inputs, targets, fresh, live, _, state = next(lm.windows(docs, 2, 10))
    state = np.zeros(state.shape)
    grads, _, loss = net.gradients(inputs, targets, fresh, live, state)

    def again():
        return net.gradients(inputs, targets, fresh, live, state)[2]

    rows, values = grads["X"]  # of the rows that were read
    grads["X"] = np.zeros_like(net.w["X"])
    grads["X"][rows] = values
    for name, w in net.w.items():
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in w.shape)
            old, h = w[at], 1e-2
            w[at] = old + h
            up = again()
            w[at] = old - h
            down = again()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * h), abs=2e-3)


def test_probabilities_sum_to_one(monkeypatch):
    small(monkeypatch)
    net, state = lm.Network(), np.append(np.random.default_rng(1).standard_normal((1, 5)), [[1]], 1).astype(np.float32)
    logs = [net.log_probs(state, np.array([s]))[0] for s in range(15)]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_windows_cover_each_document_once_in_order():
    docs = [[i] * (1 + i % 7) + [50 + i] for i in range(40)] + [[]]
    seen = {i: [] for i in range(41)}
    for _, targets, _, live, number, _ in lm.windows(docs, 8, 4):
        for t in range(4):
            for s in range(targets.shape[1]):
                if live[t, s]:
                    seen[number[t, s]].append(targets[t, s])
    assert all(seen[i] == docs[i] for i in range(41))


def test_scores_do_not_depend_on_slots_or_windows():
    rng, net = np.random.default_rng(2), lm.Network()
    docs = [list(rng.integers(0, lm.HEAD + lm.TAIL, n)) for n in (40, 3, 100, 1, 17)]

    def score(slots, steps):
        out = np.zeros(len(docs))
        for inputs, targets, fresh, live, number, state in lm.windows(docs, slots, steps):
            seen, last, _ = net.run(inputs, fresh, state)
            state[:] = last
            on = live.ravel()
            out += np.bincount(number.ravel()[on], net.log_probs(seen.reshape(-1, lm.SIZE + 1)[on], targets.ravel()[on]), minlength=len(docs))
        return out

    assert np.allclose(score(1, 200), score(3, 16), atol=1e-2)
    assert np.allclose(score(5, 7), score(2, 1), atol=1e-2)


def test_base_scores_equal_brute_force(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (repr(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 4))
        for i, t in rows
    )
    got = lm.score_documents(odd).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_the_model_beats_counts_where_context_tells(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):  # two languages; within a text all words are of one
        own = [f"{'en' if i % 2 else 'de'}{k}" for k in range(30)]
        rows.append((i, " ".join(rng.choice(own, 60))))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.15 * 60 * len(got)


def test_every_training_token_is_trained_on(spark, monkeypatch):
    """Replicas see each document whole, words past any first windows and the end token included."""
    held, stored = [], lm.stored

    def kept(df, name):
        held.append(stored(df, name))
        return held[-1]

    monkeypatch.setattr(lm, "stored", kept)
    rows = [f"a{i} b{i}" for i in range(50)] + [" ".join(f"w{k}" for k in range(700))]
    docs = spark.createDataFrame([(t,) for t in rows], "_text string").repartition(2)
    vocabulary = lm.Vocabulary(lm.frequent_tokens(lm.count_tokens(docs)))
    symbols = vocabulary.encode(pa.array(rows), np.zeros(lm.TAIL))["symbols"].to_pylist()
    tokens = sum(len(brute_tokens(t)) for t in rows)
    table = spark.createDataFrame([(i * 7919, bytearray(x)) for i, x in enumerate(symbols)], "_key long, _symbols binary")
    lm.average_replicas(table, lm.Network(), tokens)
    assert sum(r.n for r in held[0].where("c = 0").collect()) == tokens


def brute_tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_arrow_words_are_those_of_python(odd):
    texts = [r.text for r in odd.collect()] + ["  a\x0bB\x0cc\x85\x1cd ", "Z" * 200 + " z", ""]
    codes, distinct, bounds = lm.words_of(pa.array(texts))
    for i, text in enumerate(texts):
        got = [distinct[int(c)].as_py() for c in codes[bounds[i] : bounds[i + 1]]]
        want = [w if len(w) <= lm.WORD_BYTES else b"\n" + hashlib.sha256(w).digest() for w in brute_tokens(text)[:-1]]
        assert got == want


def test_symbols_and_sums_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(rng.zipf(1.3)) % 5000}x" for _ in range(rng.integers(0, 90))) for _ in range(200)]
    known = Counter(w for t in texts[:150] for w in brute_tokens(t)).most_common(900)
    vocabulary, floor = lm.Vocabulary(known), rng.random(lm.TAIL)
    found = {k: v.to_pylist() for k, v in vocabulary.encode(pa.array(texts), floor).items()}
    table = dict(known)
    place = {w: i for i, (w, _) in enumerate(known)}
    for i, text in enumerate(texts):
        words = brute_tokens(text)
        symbols = [place[w] if place.get(w, lm.HEAD) < lm.HEAD else lm.HEAD + int(lm.tail_classes(pa.array([w]))[0]) for w in words]
        assert np.frombuffer(found["symbols"][i], np.int16).tolist() == symbols and found["n_tokens"][i] == len(words)
        assert found["known"][i] == sum(w in table for w in words)
        assert found["base"][i] == pytest.approx(sum(np.log10(table[w] + 0.5) for w in words if w in table))
        assert found["model"][i] == pytest.approx(sum((np.log10(table[w] + 0.5) if w in table else 0) - floor[s - lm.HEAD] for w, s in zip(words, symbols) if s >= lm.HEAD))
        assert dict(zip(found["rare"][i], found["times"][i])) == dict(Counter(w for w in words if w not in table))


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice([f"v{k}" for k in range(300)], rng.integers(1, 80)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n)).collect()} for n in (2, 16))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-5) for i in a)


def test_vocabulary_of_very_many_words_of_like_count(spark, monkeypatch):
    """A step of counts that goes beyond KNOWN comes in by hash; the vocabulary is never empty."""
    monkeypatch.setattr(lm, "KNOWN", 500)
    docs = spark.createDataFrame([(" ".join(f"w{i}_{k}" for k in range(100)),) for i in range(40)], "_text string")
    known = lm.frequent_tokens(lm.count_tokens(docs))
    assert 450 < len(known) <= 500 and known[0] == (b"\n", 40)


def test_whole_score_equals_brute_force(spark, monkeypatch):
    """One text after the other, one word at a time, from the model's own weights."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"v{k}" for k in range(40)] + [f"r{i}"], rng.integers(0, 30)))) for i in range(120)]
    kept = {}

    def average(table, start, tokens, real=lm.average_replicas):
        kept["net"] = real(table, start, tokens)
        return kept["net"]

    monkeypatch.setattr(lm, "average_replicas", average)
    monkeypatch.setattr(lm, "HEAD", 64)
    monkeypatch.setattr(lm, "WIDTH", 16)
    monkeypatch.setattr(lm, "CLASSES", 4 + lm.TAIL)
    monkeypatch.setattr(lm, "KNOWN", 80)
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in brute_tokens(t))
    head = {w: i for i, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:64])}
    tail = lambda w: int(lm.tail_classes(pa.array([w]))[0])
    n, v = Counter(), Counter()
    for w, k in c.items():
        if w not in head:
            n[tail(w)] += k
            v[tail(w)] += 1
    w = {k: x.astype(np.float64) for k, x in kept["net"].w.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: x - np.log(np.exp(x).sum())
    for i, text in rows:
        state, before, score = np.zeros(lm.SIZE), None, 0.0
        for word in brute_tokens(text):
            gates = w["X"][before] if before is not None else np.zeros(3 * lm.SIZE)
            zr = sig(gates[: 2 * lm.SIZE] + state @ w["R"])
            z, r = zr[: lm.SIZE], zr[lm.SIZE :]
            new = np.tanh(gates[2 * lm.SIZE :] + (r * state) @ w["N"])
            state = new + z * (state - new)
            classes = soft(state @ w["C"] + w["c"])
            if word in head:
                k, at = divmod(head[word], 16)
                score += (classes[k] + soft(state @ w["O"][k] + w["o"][k])[at]) / np.log(10)
                before = head[word]
            else:
                k = tail(word)
                score += classes[4 + k] / np.log(10) + np.log10((c[word] + 0.5) / (n[k] + 0.5 * (v[k] + 1)))
                before = 64 + k
        assert got[i] == pytest.approx(score, rel=1e-4, abs=1e-3)
