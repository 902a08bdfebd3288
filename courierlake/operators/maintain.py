"""Deduplication, retention, tags, deletion, key-value tables and rebuilding: tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mime import reattached
from ..session import settled
from .entities import orphan_blobs
from .filters import retention_expired


def latest_copies(messages: DataFrame, key=("account_id", "mailbox_id", "content_hash")) -> DataFrame:
    """Of rows with equal keys the one ingested last; of equal times the smallest id. An aggregate picks it, so a
    key with very many copies is reduced before the shuffle."""
    rest = [c for c in messages.columns if c not in key]
    order = F.struct((-F.col("ingest_at")).alias("a"), F.col("id").alias("b"))
    best = messages.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*(F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in messages.columns))


def dedup(messages: DataFrame, attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest copies, and the attachments without those of the copies that went."""
    kept = latest_copies(messages)
    gone = messages.select("id").join(kept.select("id"), "id", "left_anti")
    return kept, attachments.join(gone.select(F.col("id").alias("eid")), "eid", "left_anti")


def newest_per_key(df: DataFrame, key: str, order: str, n: int = 5, tie: str = "id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order), tie)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def newest(df: DataFrame, order: str, n: int = 200, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(order), tie).limit(n)


def visible(df: DataFrame, predicate: Column, order: str, limit: int = 50) -> DataFrame:
    """The newest rows that hold; 50 by default and 200 at most."""
    return df.where(predicate).orderBy(F.desc(order), "id").limit(min(limit, 200))


#: Uids in a block: what one task ranks at most.
UID_BLOCK = 65_536


def _blocks(df: DataFrame, key: str, uid: str) -> DataFrame:
    """The uids of each key once, each with its block and its rank there, so that a key with very many is many tasks.
    Rows without a key or uid are left out."""
    one = df.select(key, uid).where(F.col(key).isNotNull() & F.col(uid).isNotNull()).distinct().withColumn("__block", F.col(uid) - F.pmod(uid, F.lit(UID_BLOCK)))
    return one.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__block").orderBy(uid)).cast("long"))


def uid_ranges(df: DataFrame, key: str, uid: str = "uid") -> DataFrame:
    """The uids of each key as ranges, such as ``1:3,7,9:10``; repeats count once. Ranges are found in blocks of uids;
    only those that reach the edge of a block are ordered over the whole key, to be joined."""
    island = _blocks(df, key, uid).withColumn("__g", F.col(uid) - F.col("__rank"))
    spans = island.groupBy(key, "__block", "__g").agg(F.min(uid).alias("a"), F.max(uid).alias("b"))
    at_edge = (F.pmod("a", F.lit(UID_BLOCK)) == 0) | (F.pmod("b", F.lit(UID_BLOCK)) == UID_BLOCK - 1)
    order = Window.partitionBy(key).orderBy("a")
    apart = F.when(F.col("a") == F.lag("b").over(order) + 1, 0).otherwise(1)
    joined = spans.where(at_edge).withColumn("__new", apart).withColumn("__run", F.sum("__new").over(order)).groupBy(key, "__run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    all_spans = spans.where(~at_edge).select(key, "a", "b").union(joined.select(key, "a", "b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")))
    return all_spans.withColumn("s", F.struct("a", text.alias("t"))).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), ",").alias("ranges"))


def uid_chunks(df: DataFrame, key: str, size: int, uid: str = "uid") -> DataFrame:
    """The uids of each key in chunks of a size, each as ranges. A uid's rank is its rank in its block and the number
    of uids in the blocks before, one row a block."""
    ranked = _blocks(df, key, uid)
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy(key, "__block").agg(F.count("*").alias("__n")).select(key, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    chunk = F.floor((F.col("__before") + F.col("__rank") - 1) / size).alias("chunk")
    parts = ranked.join(starts, [key, "__block"]).select(F.struct(F.col(key), chunk).alias("kc"), uid)
    return uid_ranges(parts, "kc", uid).select(f"kc.{key}", "kc.chunk", "ranges")


def largest_distinct(attachments: DataFrame, among: int = 200, n: int = 10) -> DataFrame:
    """The largest attachments with different contents, of the ``among`` largest; may be fewer than ``n``."""
    top = attachments.orderBy(F.desc("size"), "id").limit(among)
    w = Window.partitionBy("content_hash").orderBy(F.desc("size"), "id")
    return top.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").orderBy(F.desc("size"), "id").limit(n)


def push_history(history: Column, session: Column, most: int = 30) -> Column:
    """A list of sessions with one more in front and no more than ``most``."""
    return F.slice(F.concat(F.array(session), F.coalesce(history, F.slice(F.array(session), 1, 0))), 1, most)


def keep_recent(df: DataFrame, order: str, most: int, share: float = 0.75) -> DataFrame:
    """All rows up to ``most``; the newest ``share`` of that many once there are more."""
    n = df.agg(F.count("*").alias("__n"))
    rank = df.crossJoin(F.broadcast(n))  # one row
    top = df.orderBy(F.desc(order), "id").limit(int(most * share))
    return rank.where(F.col("__n") <= most).select(*df.columns).union(top.crossJoin(F.broadcast(n)).where(F.col("__n") > most).select(*df.columns))


def sweep(messages: DataFrame, attachments: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Messages whose retention hasn't ended, and their attachments: one set-based delete."""
    gone = messages.where(retention_expired(cutoff)).select(F.col("id").alias("eid"))
    return messages.where(~retention_expired(cutoff)), attachments.join(gone, "eid", "left_anti")


def retag(df: DataFrame, wanted: DataFrame, action: str, tags: list[str], key: str = "id") -> DataFrame:
    """``df`` with tags added to, removed from or put in place of those of the wanted rows."""
    if any(not t.startswith("/") for t in tags):
        raise ValueError("tags are paths that start with /")
    given, old = F.array(*map(F.lit, tags)).cast("array<string>"), F.coalesce("tags", F.array().cast("array<string>"))
    new = {"add": F.array_union(old, given), "remove": F.array_except(old, given), "overwrite": given}[action]
    held = df.join(wanted.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return held.withColumn("tags", F.when(F.col("__hit"), F.array_sort(new)).otherwise(F.col("tags"))).select(*df.columns)


def delete(messages: DataFrame, attachments: DataFrame, blobs: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without messages (by any key column of ``gone``), their attachments and the blobs that no
    message names any more."""
    kept = messages.join(gone.select(key).distinct(), key, "left_anti").select(*messages.columns)
    ids = messages.join(gone.select(key).distinct(), key, "left_semi").select(F.col("id").alias("eid"))
    rest = attachments.join(ids, "eid", "left_anti").select(*attachments.columns)
    return kept, rest, blobs.join(orphan_blobs(blobs, kept).select("content_hash"), "content_hash", "left_anti")


def deleted_count(messages: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """How many messages a delete takes; none is an error."""
    n = F.count("*")
    return messages.join(gone.select(key).distinct(), key, "left_semi").agg(F.when(n == 0, F.raise_error(F.lit("no such message"))).otherwise(n).cast("long").alias("deleted"))


def reattach_parts(messages: DataFrame, bodies: DataFrame, key: str = "id", raw: str = "raw") -> DataFrame:
    """Messages whose placeholders are the bodies again, from a table of ``content_hash`` and ``body``. The bodies of a
    message go to its row alone; placeholders without a body stay, and messages without any aren't joined. Bodies
    are written once to the shared folder and joined by an expression of their hash, so that one which a third of all messages carry is dealt to several tasks."""
    hashes = F.array_distinct(F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(r"\[detached:([0-9a-f]{64})\]"), F.lit(1)))
    named = messages.select(key, F.explode(hashes).alias("content_hash"))
    stored = settled(bodies.select("content_hash", "body").join(named.select("content_hash").distinct(), "content_hash", "left_semi").dropDuplicates(["content_hash"]))
    by = F.reverse("content_hash").alias("__k")
    parts = named.select(key, by).join(stored.select(by, "content_hash", "body"), "__k").groupBy(key).agg(F.collect_list(F.struct("content_hash", "body")).alias("__parts"))
    held = messages.join(parts, key, "left")
    return held.withColumn(raw, F.when(F.col("__parts").isNull(), F.col(raw)).otherwise(reattached(F.col(raw), F.col("__parts")))).select(*messages.columns)


def insert_absent(store: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows to append to a store of blobs: keys that it doesn't have, once each."""
    return new.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns)


def _each_key_once(new: DataFrame, key: str, order: str | None) -> DataFrame:
    """The rows of a batch with one for each key: the last by ``order``; without an order a repeated key is an error."""
    row = F.struct(*new.columns)
    clash = F.raise_error(F.concat(F.lit("key repeated: "), F.col(key).cast("string")))
    if order:
        return new.groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")
    held = new.groupBy(key).agg(F.first(row).alias("__row"), F.count("*").alias("__n"))
    once = F.when(F.col("__n") > 1, clash).otherwise(F.col(key)).alias(key)
    return held.select(*(once if c == key else F.col(f"__row.{c}").alias(c) for c in new.columns))


def kv_insert(store: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A store with more rows; a key that exists, or that the rows repeat, is an error."""
    clash = F.when(F.col("__old"), F.raise_error(F.concat(F.lit("key exists: "), F.col(key).cast("string")))).otherwise(F.col(key))
    fresh = _each_key_once(new, key, None).join(store.select(key).distinct().withColumn("__old", F.lit(True)), key, "left").withColumn(key, clash)
    return store.unionByName(fresh.select(*store.columns))


def kv_upsert(store: DataFrame, new: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """A store with rows put over those of their keys. Of a key that the rows repeat the last by ``order`` counts; without an order it is an error."""
    once = _each_key_once(new, key, order)
    return store.join(once.select(key), key, "left_anti").select(*store.columns).unionByName(once.select(*store.columns))


def kv_update(store: DataFrame, new: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """``kv_upsert`` of keys that must exist; one that doesn't is an error."""
    known = store.select(key).distinct().withColumn("__old", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string")))
    held = new.join(known, key, "left").withColumn(key, F.when(F.col("__old").isNull(), missing).otherwise(F.col(key)))
    return kv_upsert(store, held.select(*new.columns), key, order)


def kv_delete(store: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    return store.join(gone.select(key), key, "left_anti").select(*store.columns)


def replay(snapshot: DataFrame, log: DataFrame, last_seq: int, key: str = "key", value: str = "value") -> DataFrame:
    """A table from its snapshot and the operations behind it: the last operation of each key counts. The log has
    ``seq``, ``op`` (put or delete), the key and the value; lines without an operation are skipped."""
    ops = log.where((F.col("seq") > last_seq) & F.col("op").isin("put", "delete") & F.col(key).isNotNull())
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", F.col(value).alias("v")), "seq").alias("l"))
    kept = snapshot.join(last.select(key), key, "left_anti").select(key, value)
    return kept.union(last.where("l.op = 'put'").select(key, F.col("l.v").alias(value)))


def clean_audit(log: DataFrame, now_ms: int, days: int, column: str = "ts_ms") -> DataFrame:
    """A log without entries older than some days; zero days keep all."""
    return log if days == 0 else log.where(F.col(column) >= now_ms - days * 86_400_000)


def segments_to_compact(blobs: DataFrame, share: float = 0.3) -> DataFrame:
    """Segments of which ``share`` of the bytes or more are deleted."""
    dead = F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size"))), F.lit(0))
    return blobs.groupBy("segment").agg(dead.alias("dead_bytes"), F.sum("size").alias("bytes")).where(F.col("dead_bytes") >= share * F.col("bytes"))


def rebuild_report(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, and how many of the old are missing after a rebuild."""
    both = old.select(F.col(key), F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(F.col(key), F.lit(0).alias("o"), F.lit(1).alias("n")))
    each = both.groupBy(key).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return each.agg(F.sum("o").alias("old_rows"), F.sum("n").alias("new_rows"), F.count_if((F.col("o") > 0) & (F.col("n") == 0)).alias("missing"))
