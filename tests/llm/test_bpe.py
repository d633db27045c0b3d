import base64
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken

from marginalia.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def test_every_token_of_the_vocabulary(oracle, codec):
    for token in codec.tokens:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert codec.encode(text) == oracle.encode_ordinary(text)


def test_odd_texts(oracle, codec):
    for text in ["", "a", "  x\n\n y ", "<|endoftext|>", "▁▁ naïve ﬁ 😀 \u2028\x00", "aaaa" * 3000, "don't we'll 12345 ---=== \t", "Zażółć" * 50]:
        ids = codec.encode(text)
        assert ids == oracle.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_batches_of_texts(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "JOINED", 3)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["one two three four five six seven", "", "one eight nine ten two", "six seven " + "y" * 200, "\x01 a\x01\x01b \x00", "ÿ\xff"]
    found = codec.batch(texts)
    assert found["ids"].to_pylist() == [oracle.encode_ordinary(t) for t in texts]
    assert found["decoded_sha256"].to_pylist() == [sha256(t.encode()).hexdigest() for t in texts]
    assert found["n_tokens"].to_pylist() == [len(oracle.encode_ordinary(t)) for t in texts]
    assert codec.batch([])["ids"].to_pylist() == [] and codec.batch([""])["ids"].to_pylist() == [[]]


def test_slices_of_bounded_size():
    import pyarrow as pa

    column = pa.array(["a" * n for n in (5, 1, 1, 30, 2, 2)] + [None] * 5)
    parts = list(bpe.pieces_of_batch(column, rows=4, chars=8))
    assert pa.concat_arrays(parts).equals(column) and all(len(p) <= 4 for p in parts)
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 8 for p in parts)


def test_documents(odd, empty, oracle):
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in texts:
        ids = oracle.encode_ordinary(t)
        want.append((repr(i), len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest(), ids))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_a_task_gives_its_memory_back():
    """Python workers serve the next stage too: what a task freed must not stay with them."""
    import pyarrow as pa

    from marginalia.llm.shared import trimmed

    def own():
        return int(open("/proc/self/statm").read().split()[1]) * 4 // 1024

    def run(batches):
        for batch in batches:
            held = [bytearray(60_000) for _ in range(4000)]
            held[:-1] = []  # the last one keeps the heap from shrinking by itself
            rest.append(held)
            yield batch

    rest = []
    before = own()
    plain = list(run(iter([pa.record_batch([[1]], ["a"])])))
    grown = own() - before
    assert list(trimmed(run)(iter(plain))) == plain
    assert own() - before < grown / 2
