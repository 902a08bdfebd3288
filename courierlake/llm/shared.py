"""Helpers that the corpus operators share: the shared folder, row keys and Arrow-batch sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlake.session import new_dir, settled, shared_dir, ship, tidied  # noqa: F401  the operators take them from here

#: Words are maximal runs of bytes outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that Spark hands to Python at once. Texts can be long, so the default of 10,000 rows is too many.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Keys that are broadcast at most, a few dozen bytes each; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def apart(key: str) -> Column:
    """An expression of a whole-number key to join by. An aggregation joined by its own key keeps its partitions,
    so a hot key stays in one task; by an expression both sides get exchanges, whose hot partitions adaptive
    execution splits."""
    return F.bitwise_not(F.col(key))


def fewer(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def among(df: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` whose key is among ``keys``, which are broadcast if they are counted to be few."""
    return df.join(fewer(keys), list(by), "left_semi")


def unsized(df: DataFrame) -> DataFrame:
    """``df``, marked for a sort-merge join: Spark sizes what comes from an explode by the rows before it and files by their compressed bytes, too
    low to tell whether the driver has room for a broadcast."""
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Readies a session for Python functions over long texts: executors get the package, and the rows and bytes in an
    Arrow batch are bounded, unless the session asks for fewer already."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first ``keys`` columns, cut so that no group goes on in the next piece."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not batch.num_rows:
            continue
        other = np.flatnonzero(np.any([x != x[-1] for x in now[:keys]], axis=0))
        start = int(other[-1]) + 1 if len(other) else 0
        if held and (start or any(held[-1][i][-1] != now[i][0] for i in range(keys))):
            yield [np.concatenate([h[i] for h in held] + [x[:start]]) for i, x in enumerate(now)]
            held = []
        elif start:
            yield [x[:start] for x in now]
        held.append([x[start:] for x in now])
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]


def ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of ``size`` from ``first`` on, and which range each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return (first - np.cumsum(size) + size)[of] + np.arange(len(of)), of


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from zero on as planes of bytes, each compressed."""
    squeeze = zstandard.ZstdCompressor(level=1)
    head, body = [], []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        used = [i for i in range(8) if planes[i].any()]
        parts = [squeeze.compress(planes[i].tobytes()) for i in range(max(used, default=-1) + 1)]
        head += [len(a), *(len(x) for x in parts), *[0] * (8 - len(parts))]
        body += parts
    return np.array(head, "<u4").tobytes() + b"".join(body)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    head, at, out, widen = np.frombuffer(data, "<u4", n * 9).reshape(n, 9), n * 36, [], zstandard.ZstdDecompressor()
    for size, *parts in head.tolist():
        planes = np.zeros((8, size), np.uint8)
        for i, length in enumerate(parts):
            if length:
                planes[i] = np.frombuffer(widen.decompress(data[at : at + length], max_output_size=size), np.uint8)
                at += length
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
    return out


def filesystem(uri: str):
    """The pyarrow filesystem of a URI (file, hdfs, s3, gs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """The named columns of a batch as Python lists."""
    for name in names:
        yield batch.column(batch.schema.get_field_index(name)).to_pylist()


def train_row(doc_id: str = "doc_id") -> Column:
    """Whether labels of a row may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's labels are held out; a null id counts as not held out and is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
