"""Scores of documents by a gated recurrent language model.

Tokens: A-Z lower-cased, words between ASCII white space, then one end token.  Every word has a class:

* the ``HEAD`` most frequent training tokens are cut, in order of frequency, into classes of ``WIDTH``;
  inside such a class a softmax over its words is learnt;
* every other word, seen or not, belongs to one of ``TAIL`` classes by its last letters and form; inside
  a tail class a word has the add-1/2 share of its count in the whole training corpus, and all words
  never seen share one further place.

So P(word | past) = P(class | state) * P(word | class, state) sums to one over the corpus vocabulary with
the unseen place.  The state is a GRU's.  Training is truncated backpropagation through ``STEPS`` tokens in numpy:
the driver warms a model up on a bounded sample of whole documents (``WARM``, ``WARM_TOKENS``); then every training document
goes whole, from its first word to its end token, through one of R replicas, and the replicas' mean, weighted by tokens,
is the model.  R follows from the number of training tokens alone and a document's replica and place in it from a hash of its
id and text, so the model does not hang on how the table is partitioned.  Replicas are summed in three levels, so that no task
or the driver gathers all of them.  Documents are scored whole: slots of a batch hold one document each, the state is carried
from window to window, and a slot whose document ended takes the next one.

A text is cut into words once to count them and once more to write it as symbols (two bytes a token); replicas and scores
read the symbols.  Cutting, counting and looking up are Arrow and numpy over whole batches, with no Python object for a token.
Counts of words outside the ``KNOWN`` most frequent ones (at most ``KNOWN`` * ``WORD_BYTES`` bytes are
broadcast) are joined by a shuffle on the word, one row for each document and distinct word.  A word longer than ``WORD_BYTES``
is represented by its digest everywhere, so that long words are known words like any other if they are frequent.

Defined results: null text counts as empty, which is the end token alone; every row comes back, repeated rows
too (training rows that repeat id and text go to one replica); very long texts run beside many others and memory grows with a
text's tokens, never with tokens times slots; without training rows, an empty table included, N = V = 0, every token is unseen
and the model is untrained; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Adam, held_out
from .shared import pruned, stored

FOLDS, HELD_FOLD = 5, 1
HEAD, WIDTH, TAIL = 2048, 64, 32
KNOWN, WORD_BYTES = 1 << 16, 64
SIZE = 16
STEPS = 16
SLOTS = 512  # documents side by side when texts are scored, and at most so many in training
SCORE_STEPS = 64
GROUP = 3_000_000  # tokens laid into slots together: long documents run beside many others
WARM = 1500
WARM_TOKENS = 1_000_000  # bounds the driver's work; the replicas see every document whatever its length
WARM_PASSES = 3
REPLICA_TOKENS = 4_000_000
REPLICAS = (16, 1 << 14)  # at least and at most
FLUSH = 400_000
LEVELS = 32
CHUNKS = 8
END = b"\n"  # no word can be a line break, nor start with one

CLASSES = HEAD // WIDTH + TAIL


def tail_classes(words: pa.Array) -> np.ndarray:
    """0..TAIL-1 of each word by its last three letters, or by its last sign and length for words that end otherwise."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    words = words.cast(pa.binary()) if words.type != pa.binary() else words
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]]
    data = np.append(data, np.uint8(0))  # where an empty word at the end would be read
    start, stop = ends[:-1], ends[1:]
    length = stop - start
    back = lambda k: np.where(length >= k, data[np.maximum(stop - k, start)], 0).astype(np.int64)
    one, two, three = back(1), back(2), back(3)
    letter = lambda b: (b == 0) | ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90))
    plain = (one >= 0x80) | (letter(one) & letter(two) & letter(three))
    code = np.where(plain, three << 16 | two << 8 | one, 1 << 24 | one << 8 | np.minimum(length, 9)).astype(np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TAIL


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words of the texts in order, the distinct words they stand for, and where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary())
    empty = pc.index(distinct, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:  # white space at either end leaves an empty piece
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    if len(distinct) and (pc.max(pc.binary_length(distinct)).as_py() or 0) > WORD_BYTES:
        distinct = pa.array([w if len(w) <= WORD_BYTES else END + hashlib.sha256(w).digest() for w in distinct.to_pylist()], pa.binary())
    return codes, distinct, bounds.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _summed_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of the values that each has."""
    order = np.argsort(rows, kind="stable")
    ranked = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked.take(first), np.add.reduceat(values.take(order, axis=0), first, axis=0)


class Network:
    """GRU over class-factored tokens.  Symbols: 0..HEAD-1 head words, HEAD.. tail classes."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        put = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        h = SIZE
        self.w = {
            "X": put(HEAD + TAIL, 3 * h),  # a symbol's share of the gates: embedding and input weights in one
            "R": put(h, 2 * h), "N": put(h, h),
            "C": put(h, CLASSES), "c": zero(CLASSES),
            "O": put(HEAD // WIDTH, h, WIDTH), "o": zero(HEAD // WIDTH, WIDTH),
        }

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases at the log frequencies of the symbols."""
        n = counts.astype(np.float64) + 0.5
        by_class = np.concatenate([n[:HEAD].reshape(-1, WIDTH).sum(1), n[HEAD:]])
        self.w["c"][:] = np.log(by_class / by_class.sum())
        self.w["o"][:] = np.log(n[:HEAD].reshape(-1, WIDTH) / n[:HEAD].reshape(-1, WIDTH).sum(1, keepdims=True))

    def run(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False):
        """States before each of T x B symbols, with a one at the end of each.  inputs: the symbols read before; fresh: where a document starts."""
        w, h, steps = self.w, SIZE, len(inputs)
        X, R, N = w["X"], w["R"], w["N"]
        seen = np.ones((steps, state.shape[0], h + 1), state.dtype)
        saved = np.empty((5, steps, state.shape[0], h), state.dtype) if keep else None
        begins = fresh.any(1)
        for t in range(steps):
            gates = X.take(inputs[t], axis=0)
            if begins[t]:
                gates[fresh[t]] = 0
                state = state.copy()
                state[fresh[t]] = 0
            zr = state @ R
            zr += gates[:, : 2 * h]
            zr = _sigmoid(zr)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            n = rs @ N
            n += gates[:, 2 * h :]
            np.tanh(n, out=n)
            if keep:
                for k, x in enumerate((state, z, r, rs, n)):
                    saved[k, t] = x
            state = state - n
            state *= z
            state += n
            seen[t, :, :h] = state
        return seen, state, saved

    def log_probs(self, states: np.ndarray, targets: np.ndarray, keep: bool = False):
        """Natural log P of each target's class and, for head words, of the word in it; ``states`` end with a one, which meets the biases."""
        heads = HEAD // WIDTH
        C, O = self.with_biases()
        targets = targets.astype(np.int64)
        classes = np.where(targets < HEAD, targets // WIDTH, targets - HEAD + heads)
        # a state lies in -1..1, so logits are small and need no shift before exp
        logits = np.matmul(states, C)
        own = logits.ravel().take(np.arange(len(targets)) * CLASSES + classes)
        np.exp(logits, out=logits)
        total = logits @ np.ones(CLASSES, np.float32)
        out = own - np.log(total)
        order = np.argsort(classes.astype(np.int16), kind="stable")
        bounds = np.searchsorted(classes.take(order), np.arange(heads + 1))
        n = bounds[-1]
        mine, places, inners, sums = states.take(order[:n], axis=0), targets.take(order[:n]) % WIDTH, np.empty((n, WIDTH), states.dtype), np.empty(n, states.dtype)
        for k in range(heads):
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                np.matmul(mine[a:b], O[k], out=inners[a:b])
        own = inners.ravel().take(np.arange(n) * WIDTH + places)
        np.exp(inners, out=inners)
        np.matmul(inners, np.ones(WIDTH, states.dtype), out=sums)
        out[order[:n]] += own - np.log(sums)
        if not keep:
            return out
        logits /= total[:, None]
        inners /= sums[:, None]
        return out, classes, logits, (order[:n], bounds, mine, places, inners)

    def with_biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and word weights with their biases as a last row."""
        w = self.w
        return np.concatenate([w["C"], w["c"][None]]), np.concatenate([w["O"], w["o"][:, None, :]], 1)

    def gradients(self, inputs, targets, fresh, live, state):
        """Gradients of the window's mean loss over live places; the new state; the loss."""
        w, h, (steps, b) = self.w, SIZE, inputs.shape
        seen, last, saved = self.run(inputs, fresh, state, keep=True)
        flat, goal, all_live = seen.reshape(-1, h + 1), targets.ravel(), bool(live.all())
        on = None if all_live else np.flatnonzero(live.ravel())
        if on is not None:
            flat, goal = flat.take(on, axis=0), goal.take(on)
        logp, classes, probs, (order, bounds, mine, places, inners) = self.log_probs(flat, goal, keep=True)
        C, O = self.with_biases()
        share, g = 1 / max(1, len(goal)), {k: np.zeros_like(v) for k, v in w.items() if k in "ORNo"}
        probs.ravel()[np.arange(len(goal)) * CLASSES + classes] -= 1
        by_class = flat.T @ probs
        by_class *= share
        g["C"], g["c"] = by_class[:h], by_class[h]
        dflat = probs @ w["C"].T
        inners.ravel()[np.arange(len(mine)) * WIDTH + places] -= 1
        dmine = np.empty((len(mine), h), flat.dtype)
        for k in range(HEAD // WIDTH):
            at, to = bounds[k], bounds[k + 1]
            if to > at:
                by_word = mine[at:to].T @ inners[at:to]
                by_word *= share
                g["O"][k], g["o"][k] = by_word[:h], by_word[h]
                np.matmul(inners[at:to], w["O"][k].T, out=dmine[at:to])
        dflat[order] += dmine
        dflat *= share
        if on is not None:
            part, dflat = dflat, np.zeros((steps * b, h), flat.dtype)
            dflat[on] = part
        dseen, dstate = dflat.reshape(steps, b, h), np.zeros((b, h), flat.dtype)
        dgates = np.empty((steps, b, 3 * h), flat.dtype)
        Rt, Nt, begins = np.ascontiguousarray(w["R"].T), np.ascontiguousarray(w["N"].T), fresh.any(1)
        for t in range(steps - 1, -1, -1):
            before, z, r, rs, n = saved[:, t]
            dzr, dn = dgates[t, :, : 2 * h], dgates[t, :, 2 * h :]
            ds = dstate + dseen[t]
            keep = ds * z
            ds -= keep
            np.multiply(ds, 1 - n * n, out=dn)
            drs = dn @ Nt
            np.multiply((before - n) * keep, 1 - z, out=dzr[:, :h])
            drs *= r
            np.multiply(drs * before, 1 - r, out=dzr[:, h:])
            dstate = dzr @ Rt
            dstate += keep
            dstate += drs
            if begins[t]:
                dstate[fresh[t]] = 0
                dgates[t][fresh[t]] = 0  # no symbol was read there, and the state before it is none
        # where a document begins the state and its share of the gates are zero, so those rows add nothing below
        flat_gates = dgates.reshape(-1, 3 * h)
        g["N"] = saved[3].reshape(-1, h).T @ flat_gates[:, 2 * h :]
        g["R"] = saved[0].reshape(-1, h).T @ flat_gates[:, : 2 * h]
        g["X"] = _summed_rows(inputs.ravel(), flat_gates)
        return g, last, -float(logp.sum() * share)

    def train(self, documents: list[np.ndarray], rate: float, slots: int, passes: int = 1) -> int:
        """Truncated backpropagation over whole sequences laid into slots; returns the tokens seen."""
        adam, seen = Adam(self.w, rate), 0
        for _ in range(passes):
            for inputs, targets, fresh, live, _, state in windows(documents, slots):
                g, state[:], _loss = self.gradients(inputs, targets, fresh, live, state)
                adam.step(g)
                seen += int(live.sum())
        return seen

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log P of each sequence of symbols."""
        out = np.zeros(len(documents))
        for inputs, targets, fresh, live, number, state in windows(documents, SLOTS, SCORE_STEPS):
            seen, state[:], _ = self.run(inputs, fresh, state)
            flat, goal, own = seen.reshape(-1, SIZE + 1), targets.ravel(), number.ravel()
            if not live.all():
                on = live.ravel()
                flat, goal, own = flat[on], goal[on], own[on]
            out += np.bincount(own, self.log_probs(flat, goal), minlength=len(documents))
        return out

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def unpack(self, flat: np.ndarray) -> "Network":
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


def windows(documents: list[np.ndarray], slots: int, steps: int = STEPS):
    """Lay documents into slots and cut time into windows.

    Yields inputs, targets, fresh (document starts), live, the documents' numbers (all steps x slots) and
    the state array, to be updated in place.  A slot takes the next document where one ends, so that few
    places are idle whatever the lengths; what is held grows with the tokens, however long one document is.
    """
    slots = max(1, min(slots, len(documents)))
    sizes = [len(d) for d in documents]
    load, queues = [(0, s) for s in range(slots)], [[] for _ in range(slots)]
    heapify(load)
    for i in sorted(range(len(documents)), key=lambda i: -sizes[i]):  # longest first into the emptiest slot
        total, s = load[0]
        queues[s].append(i)
        heapreplace(load, (total + sizes[i], s))
    ends = np.array([sum(sizes[i] for i in q) for q in queues], np.int64)
    order = np.argsort(-ends, kind="stable")
    ends, placed = ends[order], [i for s in order for i in queues[s] if sizes[i]]
    total = int(ends.sum())
    if not total:
        return
    flat = np.concatenate([np.asarray(documents[i]) for i in placed]).astype(np.int16)
    lengths = np.array([sizes[i] for i in placed])
    number = np.repeat(np.array(placed, np.int32), lengths)
    first = np.zeros(total, bool)
    first[np.cumsum(lengths) - lengths] = True
    starts = np.cumsum(ends) - ends
    state, step = np.zeros((slots, SIZE), np.float32), np.arange(steps)[:, None]
    for at in range(0, int(ends[0]), steps):
        width = int((ends > at).sum())  # slots that still have tokens come first
        place = np.minimum(starts[:width] + at + step, total - 1)
        live = at + step < ends[:width]
        targets = np.where(live, flat[place], np.int16(0))
        yield flat[np.maximum(place - 1, 0)], targets, first[place] & live, live, np.where(live, number[place], np.int32(-1)), state[:width]


def slots_for(tokens: int) -> int:
    """Documents side by side in training: fewer where there are few tokens, so that they give some steps yet."""
    return int(min(SLOTS, max(8, tokens // 512)))


class Vocabulary:
    """Known words by frequency: their symbols (head words are their ranks, others their tail class) and log10(count + 1/2)."""

    def __init__(self, known: list[tuple[bytes, int]]):
        self.words = pa.array([w for w, _ in known], pa.binary())
        self.value = np.log10(np.array([n for _, n in known], np.float64) + 0.5)
        self.end = next((i for i, (w, _) in enumerate(known) if w == END), -1)
        self.end_symbol = int(self.symbols_of(pa.array([END], pa.binary()))[0][0])

    def symbols_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A symbol for each word, and its place among the known words (-1: none)."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where((at >= 0) & (at < HEAD), at, HEAD + tail_classes(distinct)).astype(np.int16), at

    def encode(self, texts: pa.Array, floor: np.ndarray) -> dict[str, pa.Array]:
        """Columns for each text: symbols, n_tokens; known tokens and their sum of log10(c + 1/2) (base); what tail words add to
        the model's score (model); the other words (rare) and how often each comes (times).

        A tail word adds log10(c + 1/2) less its class's total (``floor``); for the rare the first comes with the join.
        """
        codes, distinct, bounds = words_of(texts)
        n, (symbol, at) = len(texts), self.symbols_of(distinct)
        known, tail = at >= 0, symbol >= HEAD
        log = np.zeros(len(at))
        log[known] = self.value[at[known]]
        inner = np.where(tail, log - floor[np.where(tail, symbol - HEAD, 0)], 0.0) if len(at) else log
        owner = np.repeat(np.arange(n), np.diff(bounds))
        by_text = lambda x: np.bincount(owner, x[codes], minlength=n)
        counted = float(self.end >= 0)
        end_log = self.value[self.end] if self.end >= 0 else 0.0
        end_inner = end_log - floor[self.end_symbol - HEAD] if self.end_symbol >= HEAD else 0.0
        stream = np.empty(len(codes) + n, np.int16)
        ends = bounds[1:] + np.arange(n)
        stream[ends] = self.end_symbol
        stream[np.arange(len(codes)) + owner] = symbol[codes]
        odd = ~known[codes]
        pairs, times = np.unique(owner[odd] * max(1, len(at)) + codes[odd], return_counts=True)
        per_text = np.bincount(pairs // max(1, len(at)), minlength=n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32())
        own = pa.py_buffer(np.concatenate([[0], (ends + 1) * 2]).astype(np.int32).tobytes())
        return {
            "symbols": pa.Array.from_buffers(pa.binary(), n, [None, own, pa.py_buffer(stream.tobytes())]),
            "n_tokens": pa.array(np.diff(bounds) + 1, pa.int64()),
            "known": pa.array((by_text(known.astype(np.float64)) + counted).astype(np.int64)),
            "base": pa.array(by_text(log) + end_log),
            "model": pa.array(by_text(inner) + end_inner),
            "rare": pa.ListArray.from_arrays(offsets, distinct.take(pa.array(pairs % max(1, len(at))))),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        }


def symbol_arrays(column: pa.Array) -> list[np.ndarray]:
    """The sequences of a column of :meth:`Vocabulary.encode`'s symbols, without a copy."""
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b].view(np.int16) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def count_tokens(rows: DataFrame) -> DataFrame:
    """token -> n over rows (_text), counted in each task before the shuffle; memory is bounded by flushing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.RecordBatch:
            table = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).select(["token", "n_sum"]).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=["token", "n"])

        texts = 0
        for batch in batches:
            codes, distinct, _ = words_of(batch.column(0))
            texts += batch.num_rows
            n = np.bincount(codes, minlength=len(distinct))
            met = n > 0
            held.append(pa.table({"token": distinct.filter(pa.array(met)), "n": pa.array(n[met], pa.int64())}))
            if sum(t.num_rows for t in held) > FLUSH:
                out = merged()
                if out.num_rows > FLUSH // 2:
                    yield out
                else:
                    held.append(pa.Table.from_batches([out]))
        if texts:
            held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([texts], pa.int64())}))
            yield merged()

    return rows.select("_text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_tokens(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent tokens, at most ``KNOWN``, the most frequent first; the end token is always one of them.

    A histogram of counts in narrow steps (some hundred rows) gives the least count to ask for, so that the driver
    receives no more than it keeps, from however many tasks.  Of the step that would go beyond ``KNOWN`` the words with the
    least hashes come in, by a histogram of hashes.
    """
    steps = counts.withColumn("step", F.floor(F.log2("n") * 32).cast("int")).withColumn("bin", F.shiftrightunsigned(F.xxhash64("token"), 52))
    room, least = KNOWN - 1, None
    chosen = F.col("token") == F.lit(END)
    for r in sorted(steps.groupBy("step").count().collect(), key=lambda r: -r.step):
        if r["count"] > room:
            bins, upto = steps.where(F.col("step") == r.step).groupBy("bin").count().collect(), -1  # at most 4,096 rows
            for b in sorted(bins, key=lambda b: b.bin):
                if b["count"] > room:
                    break
                room, upto = room - b["count"], b.bin
            chosen |= (F.col("step") == r.step) & (F.col("bin") <= upto)
            break
        room, least = room - r["count"], r.step
    if least is not None:
        chosen |= F.col("step") >= least
    rows = steps.where(chosen).select("token", "n").collect()
    return sorted(((bytes(r.token), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


PARTS = pa.schema([("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("w", pa.binary())])


def _summed(parts: DataFrame, by: int, tasks: int) -> DataFrame:
    """Sums of the pieces (b, c, n, w) by b modulo ``by`` and by c, always in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for b, c, n, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = sums.setdefault((b % by, c), [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(w, np.float64)
        if sums:
            rows = [(b, c, n, w.tobytes()) for (b, c), (n, w) in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), PARTS, strict=True)], schema=PARTS)

    dealt = parts.repartition(tasks, F.col("b") % by, "c").sortWithinPartitions("b", "c")
    return dealt.mapInArrow(run, "b bigint, c bigint, n bigint, w binary")


def average_replicas(rows: DataFrame, start: Network, tokens: int) -> Network:
    """Train replicas from ``start`` on rows (_key, _symbols) of ``tokens`` tokens in all and average them, weighted by tokens.

    ``_key``: a hash that deals documents to replicas and orders them there.
    """
    base = rows.sparkSession.sparkContext.broadcast(start.packed())
    size, count = len(start.packed()), min(max(REPLICAS[0], -(-tokens // REPLICA_TOKENS)), REPLICAS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, network, seen, ready, held = None, None, 0, [], 0

        def train() -> int:
            return network.train(ready, 0.003, slots_for(held))

        def out() -> Iterator[pa.RecordBatch]:
            flat = (network.packed().astype(np.float64) - base.value) * seen
            for c, part in enumerate(np.array_split(flat, CHUNKS)):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, c, seen, part.tobytes()), PARTS, strict=True)], schema=PARTS)

        for batch in batches:
            buckets = batch.column(0).to_pylist()
            for b, symbols in zip(buckets, symbol_arrays(batch.column(1)), strict=True):
                if b != bucket:
                    if bucket is not None:
                        seen += train()
                        yield from out()
                    bucket, network, seen, ready, held = b, Network().unpack(base.value), 0, [], 0
                ready.append(symbols)
                held += len(symbols)
                if held > GROUP:
                    seen += train()
                    ready, held = [], 0
        if bucket is not None:
            seen += train()
            yield from out()

    own = rows.select(F.pmod("_key", F.lit(count)).cast("int").alias("_b"), "_key", "_symbols")
    own = own.repartitionById(count, F.col("_b")).sortWithinPartitions("_b", "_key", "_symbols").select("_b", "_symbols")
    parts = stored(own.mapInArrow(run, "b bigint, c bigint, n bigint, w binary"), "replicas")
    found = _summed(_summed(parts, LEVELS, LEVELS), 1, CHUNKS).collect()  # CHUNKS pieces of a model of fixed size
    if not found:
        return start
    flat, total = np.zeros(size), sum(r.n for r in found if r.c == 0)
    for c, place in enumerate(np.array_split(np.arange(size), CHUNKS)):
        flat[place] = sum(np.frombuffer(r.w, np.float64) for r in found if r.c == c) / total
    return Network().unpack((base.value + flat).astype(np.float32))


def warm_up(rows: DataFrame, network: Network) -> None:
    """Train on whole documents of rows (_key, _symbols, n_tokens) in the order of their keys: ``WARM`` at most, ``WARM_TOKENS`` in all."""
    n = rows.count()
    if n > 4 * WARM:  # a cut on the hash, so that tasks do not each send WARM rows
        rows = rows.where(F.col("_key") < F.lit(int(-(2**63) + 2**64 * (4 * WARM / n))))
    first = rows.select("_key", "n_tokens").orderBy("_key", "n_tokens").limit(WARM).collect()
    room, keys = WARM_TOKENS, []
    for r in first:
        if r.n_tokens <= room:
            room -= r.n_tokens
            keys.append(r._key)
    if keys:
        # rows that repeat id and text share a key: one of them is enough here
        found = rows.where(F.col("_key").isin(keys)).groupBy("_key").agg(F.min("_symbols").alias("_symbols")).orderBy("_key").collect()
        network.train([np.frombuffer(r._symbols, np.int16) for r in found], 0.01, 64, WARM_PASSES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = pruned(docs, _id=id_col, _text=text_col).withColumn("_held", held_out("_id", FOLDS, HELD_FOLD))

    counts = stored(count_tokens(rows.where(~F.col("_held"))), "counts")
    total = counts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V")).first()
    N, V = int(total.N or 0), int(total.V)
    known = frequent_tokens(counts)
    words = spark.sparkContext.broadcast(known)

    tail_n, tail_v = tail_totals(counts, words)
    start = Network()
    start.start_from(np.concatenate([np.array([n for _, n in known[:HEAD]] + [0] * (HEAD - len(known[:HEAD]))), tail_n]))
    floor = np.log10(tail_n + 0.5 * (tail_v + 1))  # log of a tail class's add-1/2 total
    kind = rows.schema["_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, row = Vocabulary(words.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            found = vocabulary.encode(batch.column(1), floor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *batch.columns[2:], *found.values()],
                names=["_row", "_id", "_held", "_key", *found],
            )
            row += batch.num_rows

    columns = "symbols binary, n_tokens bigint, known bigint, base double, model double, rare array<binary>, times array<bigint>"
    keyed = rows.select("_id", "_text", "_held", F.xxhash64("_id", F.xxhash64("_text")).alias("_key"))
    first = stored(keyed.mapInArrow(encode, f"_row bigint, _id {kind}, _held boolean, _key bigint, {columns}"), "first")
    learn = first.where(~F.col("_held")).select("_key", "n_tokens", F.col("symbols").alias("_symbols"))
    warm_up(learn, start)
    network = average_replicas(learn, start, N)
    model = spark.sparkContext.broadcast(network.packed())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, parts, ready, held = Network().unpack(model.value), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            neural, at = net.score(ready) / np.log(10), 0
            for part in parts:
                own = neural[at : at + part.num_rows] + part.column(part.num_columns - 1).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own)], names=part.schema.names)
                at += part.num_rows

        for batch in batches:
            ready += symbol_arrays(batch.column(0))
            parts.append(pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]))
            held += sum(map(len, ready[-batch.num_rows :])) if batch.num_rows else 0
            if held > GROUP:
                yield from out()
                parts, ready, held = [], [], 0
        yield from out()

    met = first.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_row", F.col("r.rare").alias("token"), F.col("r.times").alias("t"))
    met = met.join(counts, "token", "left")
    each = F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    sums = met.groupBy("_row").agg(F.sum(each).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("t")).otherwise(0)).alias("seen"))
    logs, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    base_total = float(np.log10(N + 0.5 * (V + 1)))
    schema = f"_row bigint, _id {kind}, _held boolean, n_tokens bigint, known bigint, base double, model double"
    scored = first.select("symbols", "_row", "_id", "_held", "n_tokens", "known", "base", "model").mapInArrow(score, schema)
    return scored.join(sums, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("known") + seen).alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def tail_totals(counts: DataFrame, known) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each tail class, over all training tokens that are no head words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n, v = pa.array([w for w, _ in known.value[:HEAD]], pa.binary()), np.zeros(TAIL), np.zeros(TAIL)
        for batch in batches:
            rest = pc.invert(pc.is_in(batch.column(0), value_set=head))
            k, times = tail_classes(batch.column(0).filter(rest)), batch.column(1).filter(rest).to_numpy()
            n += np.bincount(k, times, minlength=TAIL)
            v += np.bincount(k, minlength=TAIL)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["k", "n", "v"])

    found = counts.select("token", "n").mapInArrow(run, "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in found.collect():
        n[r.k], v[r.k] = r.n, r.v
    return n, v
