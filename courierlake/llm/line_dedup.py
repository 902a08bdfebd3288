"""Line deduplication: of lines that many documents share, one document keeps its own.

Lines are exploded to hashes of their normalised keys, and distinct documents are counted for each hash. The hashes that
reach the threshold go back to the documents that must lose them, and each text is put together again from the
positions that stay. Only hashes and ids are grouped by key; a whole text moves once, to meet its own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, columns, fewer, settled, small_batches

#: Code points of a key at least, and documents that hold it at least.
LEAST_CHARS, LEAST_DOCS = 10, 2
#: Bytes whose first bits are those of characters' later bytes in UTF-8.
_LATER = bytes(range(0x80, 0xC0))


def key_hashes(text: bytes, least_chars: int) -> list[bytes | None]:
    """128 bits for each line's key (stripped of ASCII white space, A-Z in lower case); None for keys that are too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= least_chars and (key.isascii() or len(key.translate(None, _LATER)) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _holders(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(doc_id, h)`` for the distinct long keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc_id, text in zip(*columns(batch, "doc_id", "text")):
                found = set(key_hashes(text, least_chars)) - {None}
                ids += [doc_id] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "h"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, h binary")


def dropped_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(doc_id, hashes)``: the keys whose lines a document loses, as another one with a smaller id keeps them.

    Documents are counted by distinct ids, in two steps, so that a key in a third of all documents is reduced
    before it meets. The keys that reach ``least_docs`` are broadcast if they are counted to be few; else both sides are dealt
    by an expression of the key, whose hot partitions adaptive execution splits.
    """
    held = settled(_holders(docs, least_chars))
    shared = held.groupBy("h").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= max(2, least_docs))
    shared = fewer(settled(shared.select(F.xxhash64("h").alias("k"), "h", "first")))
    here = held.select(F.xxhash64("h").alias("k"), "h", "doc_id")
    gone = here.join(shared, ["k", "h"]).where("doc_id > first").select("doc_id", "h")
    return gone.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))  # no more than a document has lines


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least ``least_chars`` code
    points that at least ``least_docs`` documents hold lose all their lines but those in the document with the smallest id. The others
    stay as they are, in their places, joined by line feeds.

    Null and empty texts are one empty line and stay null or empty. Rows of one id are one document: they lose or keep a
    key together. Rows without an id lose nothing and count for nothing. Columns stay (also those called like inner columns), but own columns
    named ``n_lines`` or ``n_dropped`` are replaced; ``n_chars`` becomes the length of a text that lost lines. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_keys(docs, least_chars, least_docs).select(apart("doc_id").alias("__k"), F.lit(0).alias("__s"), F.col("hashes").alias("__gone"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int")).otherwise(0)  # rows without an id have no key
    own = docs.select(*(F.col(f"`{c}`") for c in names), F.bitwise_not(F.col("doc_id").cast("long")).alias("__k"), spread.alias("__s"))
    joined = own.join(gone, ["__k", "__s"], "left").drop("__k", "__s")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            n_lines, n_dropped = [], []
            for i, gone in enumerate(batch.column(len(names)).to_pylist()):
                text = texts[i] or b""
                lines = text.count(b"\n") + 1
                n_lines.append(lines)
                if gone and texts[i] is not None:
                    lost = set(gone)
                    kept = [line for line, h in zip(text.split(b"\n"), key_hashes(text, least_chars)) if h is None or h not in lost]
                    texts[i] = b"\n".join(kept)
                    lines -= len(kept)
                n_dropped.append(lines if gone and texts[i] is not None else 0)
            cols = [batch.column(j) for j in range(len(names))]
            cols[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(cols[at].type)
            if "n_chars" in names:
                j = names.index("n_chars")
                size = pc.utf8_length(cols[at]).to_pylist()
                cols[j] = pa.array([m if n else old for m, n, old in zip(size, n_dropped, cols[j].to_pylist())], cols[j].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = docs.select(*(f"`{c}`" for c in names)).schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(run, schema)
