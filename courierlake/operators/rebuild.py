"""Rebuilding a stored table: rows that can't be read are set apart with their reasons, headers are repaired, and the result is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mime import parse_message
from ..session import settled

#: What stands for a character that couldn't be decoded.
REPLACEMENT = "�"


def outcomes(stored: DataFrame, schema: str, key: str = "id", raw: str = "raw", rules: dict[str, Column] | None = None) -> DataFrame:
    """``stored`` with ``row`` (the JSON in ``raw`` by ``schema``) and ``reason`` (null for rows that are whole).

    Reasons are ``unreadable_document`` for what isn't one JSON object or has a value of another type, ``missing_id``, and the names of
    ``rules``, columns over the fields of ``row`` that hold for rows to be set apart; the first that holds counts. Null lines are unreadable.
    """
    kind = T.StructType.fromDDL(schema + ", __bad string")
    found = stored.withColumn("__row", F.from_json(F.col(raw), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    whole = T.StructType.fromDDL(schema).fieldNames()
    held = found.select(*stored.columns, F.struct(*(F.col(f"__row.{c}").alias(c) for c in whole)).alias("row"), F.col("__row.__bad").alias("__bad"))
    reason = F.when(F.col(raw).isNull() | F.col("__bad").isNotNull() | ~F.trim(raw).startswith("{"), "unreadable_document").when(F.col(f"row.{key}").isNull(), "missing_id")
    for name, holds in (rules or {}).items():
        reason = reason.when(holds, name)
    return held.select(*stored.columns, "row", reason.alias("reason"))


def rebuild(spark: SparkSession, stored: DataFrame, schema: str, path: str, key: str = "id", raw: str = "raw", rules: dict[str, Column] | None = None) -> dict:
    """Writes the whole rows of ``stored`` below ``path``/rows and the others, as they are and with their reasons, below ``path``/skipped.

    One pass makes both: rows are dealt to folders by outcome, and counted as they are written. Then the new table is
    checked: as many rows as were counted, and no id twice. Returns ``read``, ``rows`` and ``skipped``; a check that fails is an error, and
    then nothing is said to be rebuilt.
    """
    seen = Observation("rebuild")
    found = outcomes(stored, schema, key, raw, rules).withColumn("outcome", F.when(F.col("reason").isNull(), "rows").otherwise("skipped"))
    counted = found.observe(seen, F.count("*").alias("read"), F.count_if(F.col("reason").isNull()).alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
    kept = F.when(F.col("reason").isNull(), F.col("row"))
    counted.select(*(c for c in stored.columns if c != raw), F.when(F.col("reason").isNotNull(), F.col(raw)).alias(raw), kept.alias("row"), "reason", "outcome").write.mode("errorifexists").partitionBy("outcome").parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    ids = rebuilt(spark, path).groupBy(key).count()
    told = ids.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count_if(F.col("count") > 1).alias("twice")).first()
    if told.rows != counts["rows"] or counts["read"] != counts["rows"] + counts["skipped"]:
        raise ValueError(f"the rebuilt table has {told.rows} rows, not {counts['rows']}")
    if told.twice:
        raise ValueError(f"{told.twice} ids are there more than once")
    return counts


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a rebuilt table; a damaged table without any whole row gives none."""
    return spark.read.parquet(path).where("outcome = 'rows'").select("row.*")


def skip_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows that were set apart: all their columns, the stored line and the reason."""
    held = spark.read.parquet(path).where("outcome = 'skipped'")
    return held.drop("row", "outcome")


def is_garbled(x: Column) -> Column:
    return F.coalesce(x.contains(REPLACEMENT), F.lit(False))


def is_clean(x: Column) -> Column:
    return F.coalesce((x != "") & ~x.contains(REPLACEMENT), F.lit(False))


def repair_headers(messages: DataFrame, raws: DataFrame, key: str = "content_hash") -> DataFrame:
    """``messages`` with garbled subjects and attachment names decoded again from their raw messages, and ``repaired``.

    A subject is garbled if it is empty or holds a replacement character, a name if it holds one. Only rows with either meet ``raws`` (``key`` and
    ``raw``) and are parsed, each raw message once; the others pass as they are. What is decoded counts only if it isn't empty and has no
    replacement character. ``messages`` has ``subject`` and ``attachments``, an array of structs with ``filename`` and ``content_hash``; null
    arrays and names stay null, repeated rows are repaired alike, and rows whose raw message is missing or damaged stay as they are.
    """
    names = messages.columns
    damaged = (F.coalesce(F.col("subject"), F.lit("")) == "") | is_garbled(F.col("subject")) | F.coalesce(F.exists("attachments", lambda a: is_garbled(a["filename"])), F.lit(False))
    bad, fine = messages.where(damaged), messages.where(~damaged)
    due = bad.select(key).where(F.col(key).isNotNull()).distinct()
    read = settled(raws.select(key, "raw").join(due, key, "left_semi").dropDuplicates([key]).select(F.col(key).alias("__k"), parse_message(F.col("raw")).alias("__m")))
    held = bad.join(read, F.bitwise_not(F.xxhash64(bad[key])) == F.bitwise_not(F.xxhash64(F.col("__k"))), "left").where((F.col("__k") == F.col(key)) | F.col("__k").isNull())
    new = F.col("__m.subject")
    subject = F.when(((F.coalesce(F.col("subject"), F.lit("")) == "") | is_garbled(F.col("subject"))) & is_clean(new), new).otherwise(F.col("subject"))

    def renamed(a: Column) -> Column:
        own = F.filter("__m.attachments", lambda p: (p["content_hash"] == a["content_hash"]) & is_clean(p["filename"]))
        return F.when(is_garbled(a["filename"]), a.withField("filename", F.coalesce(F.get(own, F.lit(0))["filename"], a["filename"]))).otherwise(a)

    files = F.transform("attachments", renamed)
    changed = ~(subject.eqNullSafe(F.col("subject")) & files.eqNullSafe(F.col("attachments")))
    mended = held.select(*(subject.alias(c) if c == "subject" else files.alias(c) if c == "attachments" else F.col(c) for c in names), changed.alias("repaired"))
    return fine.select(*names, F.lit(False).alias("repaired")).union(mended)


def repair_attachments(attachments: DataFrame, repaired: DataFrame) -> DataFrame:
    """``attachments`` (``eid``, ``content_hash``, ``subject``, ``name``) with the subject and names of their repaired messages (``id``)."""
    part = repaired.where("repaired").select(F.col("id").alias("__e"), F.col("subject").alias("__s"), F.explode_outer("attachments").alias("__a"))
    part = part.groupBy("__e", F.col("__a.content_hash").alias("__h")).agg(F.first("__s").alias("__s"), F.first("__a.filename").alias("__f"))
    held = attachments.join(part, (F.col("eid") == F.col("__e")) & (F.col("content_hash") == F.col("__h")), "left")
    pick = {"subject": F.coalesce("__s", "subject"), "name": F.coalesce("__f", "name")}
    return held.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in attachments.columns))
