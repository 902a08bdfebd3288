"""Streaming ingest: micro-batches into tables, state for duplicates, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("account_id", "mailbox_id", "content_hash")


def first_copies(messages: DataFrame, within: str = "7 days", key=KEY, time: str = "ingest_ts") -> DataFrame:
    """Messages without repeats that come within a time; the first copy counts, where a batch ``dedup`` keeps the
    last. State is dropped behind the watermark. Of a table that isn't a stream the first copy of all counts, of equal
    times the one with the smallest id."""
    if not messages.isStreaming:
        rest = [c for c in messages.columns if c not in key]
        first = messages.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(time, "id")).alias("__row"))
        return first.select(*(F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in messages.columns))
    return messages.withWatermark(time, within).dropDuplicatesWithinWatermark(list(key))


def first_copies_after(stream: DataFrame, stored: DataFrame, within: str = "7 days", key=KEY, time: str = "ingest_ts") -> DataFrame:
    """``first_copies`` of a stream without those that a stored table has: a start on a filled table lets nothing through that is there.

    ``stored`` is the caller's choice of rows (as those of the last days). Its keys are a side of a join that each micro-batch reads as it is then; the
    stream's own keys are state, dropped behind the watermark and kept by the checkpoint over restarts. Keys with a null part are never
    equal to stored ones.
    """
    return first_copies(stream, within, key, time).join(stored.select(*key).distinct(), list(key), "left_anti").select(*stream.columns)


def start(stream: DataFrame, write, checkpoint: str, every: str | None = None):
    """Runs ``write(batch, number)`` for each micro-batch: at an interval, or once over what is there."""
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def append_once(path: str):
    """A writer that appends each micro-batch under its number, so that a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type", time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than the watermark are left out of a stream."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return held.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions of a key that end after a gap."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def audit_entries(events: DataFrame) -> DataFrame:
    """Events (``ts``, ``user_id``, ``event_type`` and JSON ``props``) as rows of an append-only log, whose keys sort by time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(F.concat(F.lpad(ms.cast("string"), 13, "0"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("key"), ms.alias("ts_ms"), F.col("user_id").alias("actor"), F.col("event_type").alias("kind"), F.col("props").alias("detail"))
