"""Message files as DataFrames, and tables as mailbox files."""

from __future__ import annotations

import base64
import io
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.mime import parse_message
from ..session import ship

#: What raw messages start with.
HEADERS = ("Return-Path:", "Received:", "Date:", "From:", "Subject:", "To:", "Message-ID:")
PST_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")


def detect_format(content: Column, name: Column) -> Column:
    """``pst``, ``mbox`` or ``eml`` by the first bytes, else by the name; null if neither tells. A mailbox needs a
    first line of seven words or more."""
    head, low = F.substring(content, 1, 4096), F.lower(name)
    line = F.regexp_extract(F.decode(head, "ISO-8859-1"), r"^([^\n]*)\n", 1)
    text = F.decode(F.substring(content, 1, 16), "ISO-8859-1")
    starts = F.lit(False)
    for h in HEADERS:
        starts = starts | text.startswith(h)
    mbox = line.startswith("From ") & (F.size(F.split(F.trim(line), r"\s+")) >= 7)
    by_name = F.when(low.endswith(".eml"), "eml").when(low.endswith(".mbox"), "mbox").when(low.endswith(".pst"), "pst")
    return F.when(F.substring(content, 1, 8) == F.lit(PST_MAGIC), "pst").when(mbox, "mbox").when(starts, "eml").otherwise(by_name)


def looks_like_text(data: bytes) -> bool:
    """Whether the first 8 KiB are text: no zero byte, and nine of ten characters are printable. An ill-formed
    byte counts as a character that isn't, a replacement character that is written out as one that is."""
    head = data[:8192]
    if not head or 0 in head:
        return False
    chars = head.decode("utf-8", "surrogateescape")
    fine = sum(not "\udc80" <= c <= "\udcff" and (c >= " " and c != "\x7f" or c in "\t\n\r\f\x1b") for c in chars)
    return fine >= 0.9 * len(chars)


def _text(x: pd.Series) -> pd.Series:
    return x.map(lambda b: looks_like_text(b or b""))


def detect_text_file(content: Column) -> Column:
    return F.pandas_udf(_text, "boolean")(content)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``raw`` and the parsed ``message`` of each file; damage is in ``message.error``, file by file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(path)
    return files.select("path", F.col("content").alias("raw"), parse_message(F.col("content")).alias("message"))


def for_first_recipient(messages: DataFrame, accounts: DataFrame, message: str = "message") -> DataFrame:
    """Delivered messages with ``account_id`` and ``mailbox_id`` (INBOX) of the account whose address their first
    recipient is; those to others drop out. Case doesn't count, and of accounts with one address the first has it."""
    own = accounts.groupBy(F.lower(F.trim("email")).alias("__to")).agg(F.min("account_id").alias("account_id"))
    to = F.lower(F.trim(F.get(F.col(message)["to"], F.lit(0))))
    return messages.withColumn("__to", to).join(own, "__to").drop("__to").withColumn("mailbox_id", F.lit("INBOX"))


def read_base64(df: DataFrame, column: str = "eml", batch: str | None = None, at: str | None = None) -> DataFrame:
    """Messages in base64 with ``raw`` and ``message``; what isn't base64 has neither. With the columns ``batch`` and ``at`` (the place of a message in its
    batch, which one request sends and one task numbers) also ``from_end``: 1 for the last of a batch, as batches are taken from there."""
    raw = F.try_to_binary(column, F.lit("base64"))
    if batch and at:
        df = df.withColumn("from_end", F.row_number().over(Window.partitionBy(batch).orderBy(F.desc(at))))
    return df.withColumn("raw", raw).withColumn("message", F.when(raw.isNotNull(), parse_message(raw)))


#: Bytes of a mailbox file in one task.
RANGE_BYTES = 128 << 20


def filesystem(path: str):
    """The filesystem of a path or URI (file, hdfs, s3, gs), and the path in it."""
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else "file://" + os.path.abspath(path))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MboxFiles(DataSource):
    """``spark.read.format("mbox_files").load(path)``: the messages of a mailbox file, or of all files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "mbox_files"

    def schema(self) -> str:
        return "path string, at bigint, raw binary"

    def reader(self, schema) -> "MboxReader":
        return MboxReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class MboxReader(DataSourceReader):
    """Reads files in ranges of bytes. A message belongs to the range that its separator line begins in, and its
    reader goes on behind the end of the range as far as the message does."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        files, path = filesystem(self.path)
        here = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True)) if here.type == fs.FileType.Directory else [here]
        if here.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return [Range(f.path, a, min(a + self.size, f.size)) for f in found if f.is_file for a in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = filesystem(self.path)
        with files.open_input_file(partition.path) as f:
            f.seek(max(partition.start - 1, 0))
            lines, at, first, held = io.BufferedReader(f, 1 << 20), partition.start, None, []
            if at:  # to the first line that begins at or behind the start
                at += len(lines.readline()) - 1
            for line in lines:
                separator = line.startswith(b"From ")
                if separator and first is not None:
                    yield partition.path, first, b"".join(held)
                    first = None
                if first is None and at >= partition.end:
                    return
                if separator:
                    first, held = at, []
                elif first is not None:
                    held.append(line)
                at += len(line)
            if first is not None:
                yield partition.path, first, b"".join(held)


def read_mbox(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``at`` (the byte at which its separator line begins) and ``raw`` of each message of mailbox files.

    A message starts behind a line that begins with ``From ``; nothing is unescaped, and what stands before the first
    such line is no message. Files are read in ranges of bytes, so a large one is many tasks; a task holds one message.
    """
    ship(spark)
    spark.dataSource.register(MboxFiles)
    return spark.read.format("mbox_files").option("rangeBytes", str(range_bytes)).load(path)


def one_line_base64(x: Column) -> Column:
    """Base64 without the line ends that Spark puts behind every 76 characters."""
    return F.translate(F.base64(x.cast("binary")), "\r\n", "")


def mbox_text(sender: str = "sender", date_ms: str = "date", raw: str = "raw", meta: str | None = None) -> Column:
    """A message as it stands in a mailbox file: a separator line, a metadata header and the message, with a line end behind."""
    at = F.timestamp_millis(F.col(date_ms))
    when = F.concat_ws(" ", F.date_format(at, "EEE MMM"), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, "HH:mm:ss yyyy"))
    line = F.concat(F.lit("From "), F.coalesce(sender, F.lit("unknown")), F.lit(" "), when, F.lit("\n"))
    head = F.concat(F.lit("X-Archive-Metadata: "), one_line_base64(F.col(meta)), F.lit("\n")) if meta else F.lit("")
    return F.concat(line, head, F.col(raw).cast("string"), F.lit("\n"))


def write_mbox(messages: DataFrame, path: str, sender: str = "sender", date_ms: str = "date", raw: str = "raw", meta: str | None = None) -> None:
    """Messages as mailbox files in the order of their dates, each as ``mbox_text`` and one more line end."""
    messages.orderBy(date_ms, "id").select(mbox_text(sender, date_ms, raw, meta).alias("value")).write.text(path)


def encode_batch(raw: list[bytes]) -> list[str]:
    return [base64.b64encode(r).decode() for r in raw]
