"""Byte-level BPE through a sentencepiece model that is written directly from the rank file.

The file's byte strings become pieces by the usual byte-to-printable-character table, scored by
negative rank, in a BPE model with identity normalisation, no dummy prefix and white space left alone.
sentencepiece merges the adjacent pair whose union scores best, the leftmost first, which is what a
rank-driven byte-pair encoder does.  Pre-tokens (matches of a pattern) are encoded separately; ids are
decoded by the inverse mapping.  Nothing is trained.

Defined results: null text counts as empty; an empty text has no ids; every row comes back, repeated
rows too; an empty table gives an empty result; very long texts are encoded whole; other columns of any name are ignored.  Memory:
some thousand texts at a time, of a million characters but for a single longer one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import pruned, trimmed

JOINED = 256  # pre-tokens that are one string for the model
GAP = "\x01"


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    return [token for _, token in ranked]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes as length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: one normal piece per token, and the unknown piece after them."""
    table = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [("".join(table[b] for b in token), -float(rank), normal) for rank, token in enumerate(tokens)]
    pieces.append(("⁇ unknown", -float(len(tokens)), unknown))
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in pieces)
    absent = (1 << 64) - 1  # -1 as a varint: no such piece
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += b"".join(_field(n, absent) for n in (41, 42, 43)) + _field(45, pieces[-1][0].encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_characters())} | {0xFF: GAP}  # no UTF-8 text has the byte 0xFF
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.decimals = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())
        self.bytes = pa.array(tokens, pa.large_binary())

    def pretokens(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens end to end, and how many each has.

        Some hundred are encoded as one string with gaps between them: a gap is no piece of the model, so nothing merges across it,
        and it comes back as the unknown id.
        """
        parts = [b"\xff".join(t.encode() for t in distinct[i : i + JOINED]) + b"\xff" for i in range(0, len(distinct), JOINED)]
        found = self.model.encode([p.decode("latin-1").translate(self.table) for p in parts], num_threads=1) if parts else []
        flat = np.concatenate([np.array(f, np.int32) for f in found]) if found else np.zeros(0, np.int32)
        gaps = np.flatnonzero(flat == len(self.tokens))
        return flat[flat != len(self.tokens)], np.diff(np.concatenate([[-1], gaps])) - 1

    def encode(self, text: str) -> list[int]:
        return self.batch([text])["ids"][0].as_py()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def batch(self, texts: list[str]) -> dict[str, pa.Array]:
        """n_tokens, ids_sha256, decoded_sha256 and ids of texts: equal pre-tokens are encoded once, and ids, their decimals and the
        bytes that they stand for are laid end to end, with no Python object for an id."""
        found = [self.find(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        coded = pa.array([t for f in found for t in f], pa.string()).dictionary_encode()
        ids, sizes = self.pretokens(coded.dictionary.to_pylist())
        own = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(ids))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[bounds].astype(np.int64)  # of each text among all ids
        ids = own.take(coded.indices).flatten()
        return {
            "n_tokens": pa.array(np.diff(ends), pa.int64()),
            "ids_sha256": pa.array(digests(self.decimals.take(ids), ends, 1)),
            "decoded_sha256": pa.array(digests(self.bytes.take(ids), ends, 0)),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
        }


def digests(pieces: pa.Array, bounds: np.ndarray, less: int) -> list[str]:
    """SHA-256 of the pieces of each text end to end, without the last ``less`` bytes."""
    if not len(pieces):
        return [hashlib.sha256(b"").hexdigest()] * (len(bounds) - 1)
    at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1][bounds].tolist()
    data = memoryview(pieces.buffers()[2] or b"")
    return [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])]


def pieces_of_batch(column: pa.Array, rows: int = 1024, chars: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of a column of texts, of bounded rows and, but for a single long text, characters."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > chars):
            yield column.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(lengths) > start:
        yield column.slice(start)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per input row: id, ids (array, or its digest columns alone), n_tokens, decoded_sha256."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokens.value, pattern)
        for batch in batches:
            at = 0
            for part in pieces_of_batch(batch.column(1)):
                found = codec.batch([t or "" for t in part.to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(found[c] for c in out[1:])], names=out)
                at += len(part)

    rows = pruned(docs, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    out = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(trimmed(run), schema).withColumnRenamed("_id", id_col)
