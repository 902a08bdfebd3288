"""Counts, sums, histograms, facets and other aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS
from ..functions.text import facet_prefixes
from ..session import settled
from .filters import within


def total(df: DataFrame, accounts=None) -> DataFrame:
    """The number of rows of some accounts: of all for none, zero for an empty set."""
    return df.where(within("account_id", accounts)).agg(F.count("*").alias("total"))


def account_stats(df: DataFrame) -> DataFrame:
    """Messages and bytes of each account."""
    return df.groupBy("account_id").agg(F.count("id").alias("messages"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def highest_uid(df: DataFrame, account, mailbox) -> DataFrame:
    """The highest uid of a mailbox; null if it is empty."""
    return df.where((F.col("account_id") == account) & (F.col("mailbox_id") == mailbox)).agg(F.max("uid").alias("max_uid"))


def thread_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("account_id", "thread_id").agg(F.count("*").alias("messages"))


def top_terms(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values with exact counts; equal counts in the order of values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), column).limit(n)


def top_accounts(df: DataFrame, accounts: DataFrame, n: int = 10) -> DataFrame:
    """The accounts with most messages and their addresses. Accounts that are gone drop out of the top, and
    none takes their place."""
    return top_terms(df, "account_id", n).join(accounts.select("account_id", "email"), "account_id")


def day_histogram(df: DataFrame, start_ms: int, end_ms: int, column: str = "date", fill: bool = True) -> DataFrame:
    """Rows of each UTC day between two instants, both inclusive. ``fill``: days without rows between the first
    and the last day that has any count zero."""
    day = (F.floor(F.col(column) / DAY_MS) * DAY_MS).cast("long")
    counts = df.where(F.col(column).between(start_ms, end_ms)).groupBy(day.alias("day_ms")).agg(F.count("*").alias("doc_count"))
    return _filled_days(counts) if fill else counts


def _filled_days(counts: DataFrame) -> DataFrame:
    """Counts by day with a zero for each day between the first and the last one."""
    ends = counts.agg(F.min("day_ms").alias("a"), F.max("day_ms").alias("b")).where("a is not null")
    days = ends.select(F.explode(F.sequence("a", "b", F.lit(DAY_MS))).alias("day_ms"))
    return days.join(counts, "day_ms", "left").select("day_ms", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def attachment_presence(df: DataFrame) -> DataFrame:
    n = F.col("regular_attachment_count")
    return df.agg(F.count_if(n >= 1).alias("with_attachment"), F.count_if(n < 1).alias("without_attachment"))


def dashboard(df: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """The figures of a dashboard in one scan: totals, presence of attachments and recent messages."""
    n, since = F.col("regular_attachment_count"), now_ms - days * DAY_MS
    return df.agg(
        F.count("*").alias("messages"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(n >= 1).alias("with_attachment"),
        F.count_if(n < 1).alias("without_attachment"), F.count_if(F.col("date").between(since, now_ms)).alias("recent"), F.max("date").alias("newest"),
    )


def dashboard_panels(df: DataFrame, accounts: DataFrame, now_ms: int, days: int = 30, n: int = 10) -> DataFrame:
    """A whole dashboard as rows of ``panel``, ``rank`` (from 1), ``key`` and ``value``: the totals, the messages of each
    recent day with gaps filled, and the top senders, accounts with their addresses, and largest messages.

    Messages are read twice: once for the largest, and once for grouping sets of everything, recent days, senders and accounts, whose
    counts are written to the shared folder and ranked from there. Of those sets only the top ``n`` are ever sorted.
    """
    since, count = now_ms - days * DAY_MS, F.col("regular_attachment_count")
    recent = F.col("date").between(since, now_ms)
    day = F.when(recent, (F.floor(F.col("date") / DAY_MS) * DAY_MS).cast("long"))
    seen = df.select("sender", "account_id", day.alias("day"), "size", "date", count.alias("n"), recent.alias("recent"))
    sets = seen.groupingSets([[], ["day"], ["sender"], ["account_id"]], "day", "sender", "account_id").agg(
        F.grouping_id().alias("set"), F.count("*").alias("doc_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("n") >= 1).alias("with_attachment"),
        F.count_if(F.col("n") < 1).alias("without_attachment"), F.count_if("recent").alias("recent"), F.max("date").alias("newest"),
    )
    sets = settled(sets)
    of = lambda bits, key: sets.where(F.col("set") == bits).where(f"{key} is not null").select(key, "doc_count")  # noqa: E731  bits of the columns left out
    totals = sets.where("set = 7").select(F.col("doc_count").alias("messages"), "bytes", "with_attachment", "without_attachment", "recent", "newest")
    figures = totals.select(F.explode(F.array(*(F.struct(F.lit("total").alias("panel"), F.lit(i).alias("rank"), F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for i, c in enumerate(totals.columns, 1)))).alias("x")).select("x.*")

    def panel(name: str, rows: DataFrame, key: str, value: str, *order) -> DataFrame:
        """Rows that are few by construction, so that one task may rank them."""
        rank = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
        return rows.select(F.lit(name).alias("panel"), rank.alias("rank"), F.col(key).cast("string").alias("key"), F.col(value).cast("long").alias("value"))

    top = lambda bits, key: of(bits, key).orderBy(F.desc("doc_count"), key).limit(n)
    first_accounts = top(6, "account_id").join(accounts.select("account_id", "email"), "account_id")
    largest = df.select("id", "size").orderBy(F.desc("size"), "id").limit(n)
    return (
        figures.union(panel("day", _filled_days(of(3, "day").withColumnRenamed("day", "day_ms")), "day_ms", "doc_count", "day_ms")).union(panel("sender", top(5, "sender"), "sender", "doc_count", F.desc("doc_count"), "sender"))
        .union(panel("account", first_accounts, "email", "doc_count", F.desc("doc_count"), "account_id")).union(panel("largest", largest, "id", "size", F.desc("size"), "id"))
    )


def facet_tree(df: DataFrame, tags: str = "tags", key: str = "id") -> DataFrame:
    """Rows under each node of the tree of tags, ancestors included, in the order of paths. A row counts once for a path, however many of its
    tags lie below; ``key`` is that of rows, so counts are summed before the one shuffle."""
    nodes = df.where(F.col(key).isNotNull()).select(F.explode(facet_prefixes(F.col(tags))).alias("path"))
    return nodes.groupBy("path").agg(F.count("*").alias("doc_count")).orderBy("path")


def attachment_metadata(df: DataFrame, columns=("attachment_ext", "attachment_category", "attachment_content_type"), most: int = 1000) -> DataFrame:
    """Values of several columns with their counts in one pass, the most frequent of each first."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = pairs.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("doc_count"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("doc_count"), "value"))
    return counts.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def contacts(df: DataFrame, single=("sender",), lists=("to", "cc", "bcc")) -> DataFrame:
    """All addresses that messages name, once each."""
    every = F.concat(F.array(*map(F.col, single)), *(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists))
    return df.select(F.explode(every).alias("contact")).where("contact != ''").distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()


def count_existing(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """How many of the wanted keys exist, each counted once."""
    return wanted.join(df.select(key), key, "left_semi").agg(F.count_distinct(key).alias("existing"))


def outcome_tally(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counts by outcome and the status of the whole: failed only if nothing else came of it."""
    n = {k: F.count_if(F.col(outcome) == k) for k in ("success", "duplicate", "outside_retention", "failed")}
    out = df.agg(*(v.alias(k) for k, v in n.items()))
    other = F.col("success") + F.col("duplicate") + F.col("outside_retention")
    return out.withColumn("status", F.when((F.col("failed") > 0) & (other == 0), "Failed").otherwise("Completed"))


def session_outcome(df: DataFrame, by: str, folder: str = "folder", failed: str = "failed") -> DataFrame:
    """Whether any folder of a session failed, and which, in the order of their names."""
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col(failed), F.col(folder)))), ", ")
    return df.groupBy(by).agg(F.bool_or(failed).alias("any_failed"), names.alias("failed_folders"))


def latest_by_status(history: DataFrame, active: DataFrame, key: str, status: str = "status", end: str = "end_time") -> DataFrame:
    """The latest success and failure of each key over past and running sessions."""
    both = history.select(key, status, end).union(active.select(key, status, end))
    at = lambda s: F.max(F.when(F.col(status) == s, F.col(end)))
    return both.groupBy(key).agg(at("Success").alias("last_success"), at("Failed").alias("last_failure"))


def duration_buckets(df: DataFrame, column: str, bounds=(0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)) -> DataFrame:
    """Cumulative counts for each upper bound, as histograms of metrics have them."""
    counts = df.agg(*(F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(column).alias("all"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    return counts.select(F.explode(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))).alias("x")).select("x.*")


def zero_filled(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    """Counts of every combination of the values of small fixed domains, zero where there is no row."""
    spark, grid = df.sparkSession, None
    for name, values in domains.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        grid = one if grid is None else grid.crossJoin(one)
    counts = df.groupBy(*domains).agg(F.count("*").alias("n"))
    return grid.join(counts, list(domains), "left").select(*domains, F.coalesce("n", F.lit(0)).alias("n"))


def prometheus_text(metrics: DataFrame, name: str = "name", labels: str = "labels", value: str = "value") -> DataFrame:
    """Metrics (a name, a map of labels and a value) as lines of the text exposition format."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat(F.col(name), F.when(F.size(F.map_keys(labels)) > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string")).alias("line"))
