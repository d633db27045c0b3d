import zlib
from hashlib import sha256

from marginalia.llm import media


def test_forms_are_lossless_and_headers_are_enough():
    for text in ["", "a", "x" * 64, "é" * 1000, "\x00\xff" * 40]:
        payload = media.payload_of(text)
        form = media.encode_png(payload)
        assert len(payload) % 64 == 0 and payload and media.decode_png(form) == payload
        assert media.read_header(form[: media.HEADER]) == (len(payload), 1, 8, 0)


def test_columns_equal_brute_force(odd, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = media.media_columns(odd).collect()
    want = []
    for i, t in rows:
        p = media.payload_of(t)
        form = media.encode_png(p)
        want.append((repr(i), len((t or "").encode()), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(form), sha256(form).hexdigest(),
                     media.feature_of(p, len(p), 1)))
    assert sorted(
        (repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got
    ) == sorted(want)
    assert all(r.length == r.media_bytes and r.width * r.height == r.payload_bytes for r in got)
    assert media.media_columns(empty).count() == 0


def test_shards_are_tar_files(odd, tmp_path):
    import tarfile

    folder = f"file://{tmp_path}/shards"
    places = media.write_shards(odd, folder).collect()
    for name in {r.shard for r in places}:
        with tarfile.open(tmp_path / "shards" / name) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))  # a content once in a shard
            for r in places:
                if r.shard == name:
                    member = tar.getmember(f"{r.digest.hex()}.png")
                    assert (member.offset_data, member.size) == (r.offset, r.length)


def test_equal_texts_are_stored_once(spark, tmp_path, monkeypatch):
    import tarfile

    monkeypatch.setattr(media, "scratch_path", lambda spark, name: f"file://{tmp_path}/shards")
    docs = spark.createDataFrame([(i, "the same text" if i < 400 else f"text {i // 2}") for i in range(440)], "doc_id long, text string").repartition(8)
    rows = media.media_columns(docs).collect()
    names = []
    for path in (tmp_path / "shards").glob("*.tar"):
        with tarfile.open(path) as tar:
            names += tar.getnames()
    assert len(rows) == 440 and len({(r.shard, r.offset) for r in rows if r.doc_id < 400}) == 1
    assert sorted(names) == sorted({f"{r.payload_sha256}.png" for r in rows})
