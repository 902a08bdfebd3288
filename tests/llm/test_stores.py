"""Media shards, WARC archives and tokens: exact round trips and edge rows."""

import hashlib
import io
import struct
import tarfile
import zlib

import public_tokenizers
import pytest
import sentencepiece
import zstandard

from courierlake.llm import media_shards, piece_tokens, warc_zstd
from courierlake.llm.shared import filesystem


def test_media(spark, edge_docs, no_docs):
    index = media_shards.store(edge_docs, shard_bytes=2000)
    rows = media_shards.read_back(media_shards.headers(index)).collect()
    texts = sorted((r.text or "") for r in edge_docs.select("text").collect())
    assert len(rows) == 11
    want = []
    for t in texts:
        raw = t.encode()
        pad = -len(raw) % 576 if raw else 576
        p = raw + b"\xff" * pad
        want.append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert all((r.width, r.height * r.width, r.bits) == (576, r.payload_bytes, 8) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    r = rows[0]
    fs, path = filesystem(r["shard"])
    with fs.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        assert {m.name for m in tar} == {x.digest + ".png" for x in rows if x["shard"] == r["shard"]}
    assert media_shards.headers(media_shards.store(no_docs)).count() == 0


def test_damaged_picture():
    png = media_shards.to_png(b"a" * 576)
    assert media_shards.from_png(png) == b"a" * 576
    for bad in (png[:20], b"x" + png[1:], png[:60] + b"?" + png[61:]):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            media_shards.from_png(bad)


def pages(spark):
    big = "<p>" + "equal page " * 30 + "</p>"
    rows = [(5, "http://x/5", big, 1), (2, "http://x/ 2\n", big, 1), (2, "http://x/2", big, 1), (9, None, big, 1), (None, "http://x/n", big, 1), (1, "u", "short", 1), (3, "u", "short", 1), (4, "u", None, 1), (6, "u", "", None), (7, "u", "ü" * 50, 1), (8, "u", "ü" * 50, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(2)


def test_warc(spark):
    archives = warc_zstd.write(pages(spark))
    found = warc_zstd.read(archives, payload=True).collect()
    src = pages(spark).collect()
    assert len(found) == len(src)
    for r in found:
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found)
    groups = {}
    for r in src:
        b = (r.html or "").encode()
        if len(b) >= 100 and r.page_id is not None:
            groups[b] = min(groups.get(b, r.page_id), r.page_id)
    want = []
    for r in src:
        b = (r.html or "").encode()
        first = groups.get(b)
        again = first is not None and r.page_id != first
        want.append((str(r.page_id), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else 0))
    assert got == sorted(want)
    assert warc_zstd.read(warc_zstd.write(pages(spark).where("page_id > 99"))).count() == 0


def test_warc_frames():
    samples = [(f"<html><head><title>{i}</title></head><body>" + "abc def " * (i % 9 + 1) + "</body></html>").encode() for i in range(300)]
    given = warc_zstd.train_dictionary(samples)
    assert given and warc_zstd.train_dictionary([]) == b""
    data = [warc_zstd.record(i, f"http://x/{i}", s, hashlib.sha256(s).hexdigest(), None) for i, s in enumerate(samples)]
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(given), write_checksum=True)
    archive = warc_zstd.dictionary_frame(given) + b"".join(map(pack.compress, data))
    assert list(warc_zstd.records(io.BytesIO(archive))) == data
    plain = struct.pack("<II", warc_zstd.SKIPPABLE, len(given)) + given + pack.compress(data[0])
    assert list(warc_zstd.records(io.BytesIO(plain))) == data[:1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc_zstd.records(io.BytesIO(archive[:-5])))
    for bad in (data[0][:-4], data[0].replace(b"WARC/1.1", b"WARC/9"), data[0].replace(b"WARC-Date", b"X-Date"), data[0].replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            warc_zstd.parse(bad)
    assert warc_zstd.parse(data[3])["page_id"] == 3


def test_tokens(spark, edge_docs, no_docs, prose_of):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = piece_tokens.encode_decode(edge_docs, model).collect()
    want = sorted((sp.encode(r.text or "", add_bos=True, add_eos=True) for r in edge_docs.select("text").collect()), key=str)
    got = sorted((list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in rows), key=str)
    assert got == want and all(r.decoded == sp.decode(list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in rows)
    assert piece_tokens.encode_decode(no_docs, model).count() == 0
    enc = piece_tokens.PieceEncoder(model)
    import random

    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice("aab cdeté▁ \n\t字漢😀ㄱ'the  <s>ñß") for _ in range(r.randrange(40)))
        assert list(struct.unpack(f"<{len(enc.encode(s)) // 4}I", enc.encode(s))) == sp.encode(s, add_bos=True, add_eos=True)
