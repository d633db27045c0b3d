"""Media columns: content-addressed payloads in tar shards.

A payload is stored once for each distinct content, as an 8-bit greyscale PNG of one
row (lossless, deflated), under its SHA-256 as the member's name.  Rows carry digest, shard, offset
and length.  Metadata columns come from range reads of the first 33 bytes of a stored form (PNG
signature and IHDR chunk); features come from the whole form read back.

1. One pass hashes the payloads (no text is kept: an id, a length and 32 bytes a row), and rows are counted by digest.
2. A blocked Bloom filter of the digests that have several rows (``MAX_BLOCKS`` rows of 72 bytes at most, whatever the input) is
   broadcast.  Texts that it does not hold are alone and go straight to their task's shard; the others, and the few that it holds by
   mistake, are reduced to one text for each digest by a pre-aggregated shuffle, and then written.
3. Members are read back in the order of their shards, and rows are joined to them by digest; digests of very many rows are joined
   on the map side (see ``joined_by_key``), so that no task gathers a large group of copies.

A task writes its own shards under names no other attempt uses, and what it wrote counts only by the index
table in the shared scratch folder, so a lost executor or a second attempt leaves at most unread files.
Shards are cut at ``SHARD_BYTES``; a shard never holds more than its task's rows, and readers open shards by task.

Defined results: a null text is the empty payload (64 zero bytes); every row comes back, repeated rows
too; equal texts get equal values; a text longer than a shard gets a shard of its own; an empty table gives an empty result; other
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined_by_key, pruned, release, scratch_path, stored
from .url_filter import bloom_filter, passes_filter

UNIT = 64
SHARD_BYTES = 256 << 20
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of one row, filter type 0: nothing comes between the samples, which deflates best."""
    head = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(b"\0" + payload, 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a form's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(form: bytes) -> bytes:
    """The samples of a PNG that :func:`encode_png` wrote."""
    width, height, depth, colour = read_header(form)
    at, data = 8, b""
    while at < len(form):
        (n,) = struct.unpack(">I", form[at : at + 4])
        if form[at + 4 : at + 8] == b"IDAT":
            data += form[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour != 0 or lines[:, 0].any():
        raise ValueError("not one of our forms")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean, standard deviation and entropy of the samples, and an 8-band histogram."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    mean = float((counts * values).sum() / n)
    sd = float(np.sqrt(max(0.0, (counts * values**2).sum() / n - mean**2)))
    share = counts[counts > 0] / n
    bands = ",".join(str(int(b)) for b in counts.reshape(8, 32).sum(axis=1))
    return f"{width}x{height};mean={mean:.4f};sd={sd:.4f};entropy={-(share * np.log2(share)).sum():.4f};bands={bands}"


def _filesystem(uri: str):
    """The file system and path of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class _Shard:
    """A tar file that is being written."""

    def __init__(self, folder: str):
        self.name = f"shard-{uuid.uuid4().hex[:16]}.tar"
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        self.file, self.at, self.members = files.open_output_stream(f"{path}/{self.name}"), 0, {}

    def add(self, digest: bytes, form: bytes) -> tuple[int, int]:
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(form)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.file.write(head + form + bytes(-len(form) % 512))
            self.members[digest] = (self.at + len(head), len(form))
            self.at += len(head) + len(form) + -len(form) % 512
        return self.members[digest]

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()


def payload_digests(texts: DataFrame) -> DataFrame:
    """Adds n_bytes and digest (SHA-256 of the payload) to rows with ``_text``."""
    raw = F.coalesce("_text", F.lit("")).cast("binary")
    n = F.octet_length(raw)
    padded = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT).cast("int")
    return texts.withColumn("n_bytes", n.cast("long")).withColumn("digest", F.unhex(F.sha2(F.rpad(raw, padded, F.lit(b"\0")), 256)))


def one_for_each(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """_text: one row for each digest of ``texts`` (_text, digest); ``sizes``: digest, _rows."""
    several = stored(sizes.where("_rows > 1").select("digest"), "several")
    bloom, blocks = bloom_filter(several, several.count(), "digest")
    bloom = stored(bloom, "bloom")
    alone = passes_filter(texts, bloom, blocks, "digest", False).select("_text")
    copies = passes_filter(texts, bloom, blocks, "digest", True).groupBy("digest").agg(F.first("_text").alias("_text"))
    return alone.unionByName(copies.select("_text"))


def write_shards(texts: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Write the payloads of texts below ``folder``, once in a shard; one row for each: digest, shard, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(0).to_pylist():
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).digest()
                    if shard is None or shard.at > SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard = _Shard(folder)
                    place = shard.members.get(digest) or shard.add(digest, encode_png(payload))
                    rows.append((digest, shard.name, *place))
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=names)
        if shard:
            shard.close()

    names = ["digest", "shard", "offset", "length"]
    return pruned(texts, _text=text_col).mapInArrow(run, "digest binary, shard string, offset bigint, length bigint")


#: What reading back gives for each member, beside its digest and place.
READ = [("width", "int"), ("height", "int"), ("bit_depth", "int"), ("payload_bytes", "bigint"), ("tail_crc32", "bigint"), ("media_sha256", "binary"), ("feature", "string")]


def read_shards(members: DataFrame, folder: str) -> DataFrame:
    """Read members (digest, shard, offset, length) back: header columns first, then the whole form.

    A payload whose digest is not its name fails the run: the digest that comes out is that of the bytes read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        name, file = None, None
        arrow = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        for batch in batches:
            rows = []
            digests, shards, offsets, lengths = (c.to_pylist() for c in batch.columns)
            for digest, shard, offset, length in zip(digests, shards, offsets, lengths, strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, files.open_input_file(f"{path}/{shard}")
                width, height, depth, _ = read_header(file.read_at(HEADER, offset))
                form = file.read_at(length, offset)
                payload = decode_png(form)
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"{shard} at {offset}: not what was stored")
                rows.append((width, height, depth, width * height * depth // 8, zlib.crc32(payload[-UNIT:]), hashlib.sha256(form).digest(), feature_of(payload, width, height)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(READ)
            found = [pa.array(list(c), arrow[kind]) for c, (_, kind) in zip(columns, READ, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *(n for n, _ in READ)])
        if file:
            file.close()

    kinds = "digest binary, shard string, offset bigint, length bigint, " + ", ".join(f"{n} {k}" for n, k in READ)
    return members.select("digest", "shard", "offset", "length").mapInArrow(run, kinds)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, payload_sha256, shard, offset, length, the columns of READ, media_bytes, media_sha256."""
    folder = scratch_path(docs.sparkSession, "shards")
    texts = payload_digests(pruned(docs, _id=id_col, _text=text_col).withColumn("_text", F.coalesce("_text", F.lit(""))))
    rows = stored(texts.select("_id", "n_bytes", "digest"), "digests")
    sizes = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    members = stored(write_shards(one_for_each(texts, sizes), folder, "_text"), "members")
    # a shard's members are read in order, by one task for each span of 1 MB
    span = F.floor(F.col("offset") / (1 << 20))
    read = stored(read_shards(members.repartition("shard", span).sortWithinPartitions("shard", "offset"), folder), "media")
    found = joined_by_key(rows, stored(read.join(sizes, "digest"), "media-sizes"), "digest", "_rows")
    release(members, read, sizes)
    hexed = lambda c, name: F.lower(F.hex(c)).alias(name)
    return found.select(
        F.col("_id").alias(id_col), "n_bytes", hexed("digest", "payload_sha256"), "shard", "offset", "length",
        *(n for n, _ in READ if n != "media_sha256"), F.col("length").alias("media_bytes"), hexed("media_sha256", "media_sha256"),
    )
