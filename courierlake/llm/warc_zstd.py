"""WARC archives of Zstandard frames with a dictionary.

An archive starts with a skippable frame that holds the dictionary, itself a Zstandard frame or as it is,
and goes on with one frame for each record. The writer stores pages as ``response`` records; of records
with equal payloads the others refer to the first as ``revisit``. The reader loads the dictionary, decodes
frame by frame in bounded memory and checks versions, headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, filesystem, new_dir, settled, small_batches

#: The magic numbers of the skippable frame of a dictionary, of a frame and of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Payloads from which the dictionary is trained at most, bytes taken of each, and bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 32 << 10, 64 << 10
#: Payload bytes from which equal payloads become revisits, bytes after which a new archive begins, bytes read at once.
LEAST_REVISIT, ARCHIVE_BYTES, PIECE = 100, 256 << 20, 16 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_unsafe = re.compile(r"[\x00-\x20\x7f]")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or none if the samples are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record with the HTTP response of a page; a revisit has the headers alone, which still tell the length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = _unsafe.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (len(payload) if refers_to is None else 0)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + (payload if refers_to is None else b"") + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"no header line: {line[:80]!r}")
        out[name.decode("ascii").strip().lower()] = value.decode().strip()
    return out


def parse(data: bytes) -> dict:
    """A record's page id, URL, type, reference, digest, payload length and payload (none of a revisit).
    A wrong version, a missing header, a wrong length, end or digest raises."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC record")
    h = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"{name} is missing")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{h['warc-record-id']}: the block isn't {n} bytes long")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{h['warc-record-id']}: the payload isn't what the headers tell")
    if kind == "revisit" and (payload or h.get("warc-profile") != PROFILE or "warc-refers-to" not in h):
        raise ValueError(f"{h['warc-record-id']}: no valid revisit")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown type {kind}")
    number = lambda uri: None if uri is None or (x := uri.strip("<>").rpartition(":")[2]) == "none" else int(x)
    return {"page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": number(h.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None}


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def records(file) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time. A frame that isn't whole raises."""
    held, dictionary = file.read(8), None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == SKIPPABLE:
        data = file.read(struct.unpack("<I", held[4:])[0])
        if struct.unpack("<I", data[:4])[0] == FRAME:
            data = zstandard.ZstdDecompressor().decompress(data)
        if struct.unpack("<I", data[:4])[0] != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        dictionary, held = zstandard.ZstdCompressionDict(data), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while held or (held := file.read(PIECE)):
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = file.read(PIECE)
            if not held:
                raise ValueError("the last frame isn't whole")
        yield b"".join(parts)


def write(pages: DataFrame, level: int = 3) -> DataFrame:
    """Writes a record for each row of ``pages`` (``page_id``, ``url``, ``html``) to archives in the shared
    folder and returns ``shard`` and ``n_records`` of each.

    Of records whose payloads are equal and have ``LEAST_REVISIT`` bytes or more, those with the smallest
    ``page_id`` are responses and the others revisits; repeated rows of that id are all responses. Null
    pages count as empty; a null ``page_id`` is never the smallest, and a group without any has responses
    alone. An empty table writes nothing. Other columns play no part.
    """
    spark = pages.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    groups = rows.where(F.length("body") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = groups.where("n > 1 and first_id is not null").select("digest", "first_id")
    # Joined by an expression, so that the digest of very many equal pages is split by adaptive execution.
    # Pages that can't be revisits, of which there may be very many equal ones, go by keys of their own that nothing meets.
    spread = F.when(F.length("body") >= LEAST_REVISIT, F.upper("digest")).otherwise(F.concat("digest", F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    held = rows.withColumn("k", spread).join(firsts.select(F.upper("digest").alias("k"), "first_id"), "k", "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()), F.col("first_id")))
    chosen = pages.select(F.xxhash64("page_id", "html").alias("h"), body.alias("body")).where(F.length("body") > 0)
    one_in = max(1, chosen.count() // SAMPLE)  # about SAMPLE payloads, chosen by hash; a dictionary is fitted to a bounded sample
    taken = chosen.where(F.pmod("h", F.lit(one_in)) == 0).orderBy("h", "body").select(F.substring("body", 1, SAMPLE_BYTES).alias("body")).limit(2 * SAMPLE).collect()
    dictionary = spark.sparkContext.broadcast(train_dictionary(sorted(bytes(r.body) for r in taken)))
    folder = new_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        task, out, at, n, path = TaskContext.get().partitionId(), None, 0, 0, ""
        given = dictionary.value
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(given)} if given else {}))
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["shard", "n_records"])
        for batch in batches:
            for i, u, b, d, r in zip(*columns(batch, "page_id", "url", "body", "digest", "refers_to")):
                if out is None:
                    path = f"{folder}/archive-{task:06d}-{uuid.uuid4().hex}.warc.zst"
                    out, n = fs.open_output_stream(f"{top}/{path.rpartition('/')[2]}"), 0
                    at = out.write(dictionary_frame(given)) if given else 0
                at += out.write(packer.compress(record(i, u, b, d, r)))
                n += 1
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    return settled(held.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(run, "shard string, n_records bigint"))


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives that the column ``shard`` names: ``page_id``, ``url``, ``record_type``,
    ``refers_to``, ``payload_digest``, ``payload_bytes`` and, if asked for, ``payload`` (null for a revisit).
    An archive with other than ``n_records`` records raises."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), *([("payload", pa.binary())] if payload else [])]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n in zip(*columns(batch, "shard", "n_records")):
                fs, path = filesystem(shard)
                rows, seen = [], 0
                with fs.open_input_stream(path) as f:
                    for data in records(f):
                        rows.append(parse(data))
                        seen += 1
                        if len(rows) == 512:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in kinds} for r in rows], schema=schema)
                            rows = []
                if seen != n:
                    raise ValueError(f"{shard} has {seen} records, not {n}")
                yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in kinds} for r in rows], schema=schema)

    return archives.select("shard", "n_records").mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint" + ", payload binary" * payload)
