"""Media columns in tar shards.

Each task packs its payloads as 8-bit greyscale PNG pictures into tar shards in the shared folder. A member
is named by the SHA-256 of its payload and stored once in a shard; rows carry the digest, the shard, the
offset and the length, so payloads aren't shuffled and a reader needs one range of bytes for a row. Header
columns come from ranges of 33 bytes.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, filesystem, new_dir, settled, small_batches

#: Samples in a row of a picture, the byte that fills the last row, and bytes after which a new shard begins.
WIDTH, FILL, SHARD_BYTES = 576, b"\xff", 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # the signature and the IHDR chunk


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text, filled up to a positive multiple of ``WIDTH``, and their number before."""
    raw = (text or "").encode()
    return raw + FILL * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def to_png(payload: bytes) -> bytes:
    """A picture with a sample for each byte, ``WIDTH`` in a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a leading zero: the row isn't filtered
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first ``HEADER_BYTES``. Damage raises."""
    if len(head) < HEADER_BYTES or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("no PNG header here")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if colour or bits != 8:
        raise ValueError("not an 8-bit greyscale picture")
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made. Damage raises."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and an average hash: which of 64 equal stretches lie above the mean."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    seen = p[p > 0]
    mean, var = float((p * np.arange(256)).sum()), float((p * (np.arange(256) - (p * np.arange(256)).sum()) ** 2).sum())
    edges = np.linspace(0, len(x), 65).astype(int)[:-1]
    bright = np.add.reduceat(x.astype(np.int64), edges) / np.diff(np.append(edges, len(x))) > mean
    return f"mean={mean:.4f};std={var**0.5:.4f};entropy={-(seen * np.log2(seen)).sum():.4f};ahash={np.packbits(bright).tobytes().hex()}"


def _member(name: str, data: bytes) -> tuple[bytes, bytes]:
    """A tar header and the padding behind the data."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.USTAR_FORMAT), b"\0" * (-len(data) % 512)


def store(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packs the whole text of each row and returns where it went.

    Returns ``doc_id``, ``n_bytes`` (of the text), ``digest`` (SHA-256 of the payload), ``shard``,
    ``offset`` and ``length`` of the picture. Equal payloads of a shard share a place. Null texts count as
    empty; an empty text has a row of fill bytes. Null and repeated ids are kept. An empty table writes
    nothing. Other columns play no part. A task that runs again writes other shards, and rows only name
    those of the attempt that counted.
    """
    small_batches(docs.sparkSession)
    folder = new_dir(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        task, out, at, name, places = TaskContext.get().partitionId(), None, 0, "", {}
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            rows = []
            for i, t in zip(ids, texts):
                payload, n = payload_of(t)
                digest = hashlib.sha256(payload).hexdigest()
                if out is not None and digest not in places and at >= shard_bytes:
                    out.write(b"\0" * 1024)
                    out.close()
                    out = None
                if out is None:
                    name, at, places = f"shard-{task:06d}-{uuid.uuid4().hex}.tar", 0, {}
                    out = fs.open_output_stream(f"{top}/{name}")
                if digest not in places:
                    png = to_png(payload)
                    head, pad = _member(digest + ".png", png)
                    out.write(head + png + pad)
                    places[digest] = (at + len(head), len(png))
                    at += len(head) + len(png) + len(pad)
                rows.append((i, n, digest, f"{folder}/{name}", *places[digest]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return settled(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"))


class _Reader:
    """Ranges of shards; the shard in use stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file is not None:
                self.file.close()
            fs, path = filesystem(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(length)


def headers(index: DataFrame) -> DataFrame:
    """``index`` with ``width``, ``height`` and ``bits``, from ranges of ``HEADER_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            found = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(*columns(batch, "shard", "offset"))]
            more = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "width", "height", "bits"])

    fields = ", ".join(f"`{c}` {t}" for c, t in index.dtypes)
    return index.mapInArrow(run, f"{fields}, width int, height int, bits int")


def read_back(index: DataFrame) -> DataFrame:
    """What the stored bytes of each row of ``headers(index)`` hold: ``payload_bytes``, ``payload_sha256``,
    ``tail_crc32`` (of its last 32 bytes), ``media_bytes``, ``media_sha256`` and ``feature``. A payload whose
    digest isn't its address raises. Rows that share a place are read once in a task and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shard, known = _Reader(), None, {}
        for batch in batches:
            rows = []
            for s, o, n, d, w, h in zip(*columns(batch, "shard", "offset", "length", "digest", "width", "height")):
                if s != shard:
                    shard, known = s, {}
                if o not in known:
                    media = reader.read(s, o, n)
                    payload = from_png(media)
                    sha = hashlib.sha256(payload).hexdigest()
                    if sha != d or len(payload) != w * h:
                        raise ValueError(f"{s} holds another payload at {o}")
                    known[o] = (len(payload), sha, zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                rows.append(known[o])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            more = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = ", ".join(f"`{c}` {t}" for c, t in index.dtypes)
    return index.mapInArrow(run, f"{fields}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
