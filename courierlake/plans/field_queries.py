"""Queries of text filters by field, and of smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mime
from ..functions import scalars as C
from ..functions import text as X
from ..operators import entities, facets, filters, maintain
from ..operators.filters import AttachmentFilter, MessageFilter
from ..streaming.changes import decode_cursor, encode_cursor
from .registry import query
from .search_queries import FOLD, GRAM, SEQ, hits
from .tables import accounts, attachments, messages, ms, read, texts


def grams_sql(column: str) -> str:
    return f"(select list_distinct(list_transform(range(1, greatest(length({column}) - 1, 1)), lambda i: " + GRAM.replace("substr(s,", f"substr(strip_accents(lower({column})),") + ")))"


def matches_sql(column: str, words: list[str], fuzzy: bool = True) -> str:
    """A query of words over one field: all of them, or for each all of its grams but one."""
    every = " and ".join(f"contains({SEQ.format(column)}, ' {w} ')" for w in words)
    if not fuzzy:
        return f"({every})"
    near = " and ".join(f"len(list_intersect({grams_sql(column)}, {sorted({w[i:i + 3] for i in range(len(w) - 2)})})) >= {len({w[i:i + 3] for i in range(len(w) - 2)}) - (1 if len(w) >= 5 else 0)}" for w in words)
    return f"(({every}) or ({near}))"


MAIL = """, mail as (select id, account_id, mailbox_id, date, subject, body, sender, [concat('user', cast(id % 90 as varchar), '@example.org'), concat('team', cast(id % 11 as varchar), '@example.net')] as tos, [concat('copy', cast(id % 7 as varchar), '@example.org')] as ccs,
  [concat('file', cast(id % 30 as varchar), '.pdf'), concat('notes ', source_of)] as names, case when id % 3 = 0 then ['pdf', 'txt'] else ['png'] end as exts, source_of
  from (select *, coalesce(mailbox_id, '') as source_of, concat('user', cast(id % 70 as varchar), '@example.com') as sender from texts))"""


def mail(spark, d):
    k = F.col("id")
    name = lambda a, n, b: F.concat(F.lit(a), (k % n).cast("string"), F.lit(b))
    empty = F.array().cast("array<string>")
    return texts(spark, d).select("*", name("user", 70, "@example.com").alias("sender"), F.array(name("user", 90, "@example.org"), name("team", 11, "@example.net")).alias("to"), F.array(name("copy", 7, "@example.org")).alias("cc"), empty.alias("bcc"), F.array(name("file", 30, ".pdf"), F.concat(F.lit("notes "), F.coalesce("mailbox_id", F.lit("")))).alias("attachment_name"), F.when(k % 3 == 0, F.array(F.lit("pdf"), F.lit("txt"))).otherwise(F.array(F.lit("png"))).alias("attachment_ext"), *(F.lit(0).cast("long").alias(c) for c in ("internal_date", "ingest_at", "size", "regular_attachment_count")), F.lit(None).cast("array<string>").alias("tags"))


@query("f03_subject", "with {t} select id from texts where " + matches_sql("subject", ["src7"]))
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(subject="src7"))


@query("f04_body", "with {t} select id from texts where " + matches_sql("body", ["erst", "that"], fuzzy=False))
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(body="erst that"))


@query("f06_sender", "with {t}" + MAIL + " select id from mail where sender = 'user7@example.com' or len(list_intersect(" + grams_sql("sender") + ", ['use','ser','er7','r7@','7@e','@ex','exa','xam','amp','mpl','ple','le.','e.c','.co','com'])) >= 14")
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(sender="user7@example.com"))


@query("f07_any_recipient", "with {t}" + MAIL + " select id from mail where list_contains(tos, 'copy4@example.org') or list_contains(ccs, 'copy4@example.org')")
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(any_recipient="copy4@example.org"))


@query("f08_any_participant", "with {t}" + MAIL + " select id from mail where sender = 'user5@example.com' or len(list_intersect(" + grams_sql("sender") + ", ['use','ser','er5','r5@','5@e','@ex','exa','xam','amp','mpl','ple','le.','e.c','.co','com'])) >= 14")
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(any_participant="user5@example.com"))


@query("f02_text_everywhere", "with {t}" + MAIL + " select id from mail where contains(" + SEQ.format("body") + ", ' erst ') or " + matches_sql("subject", ["erst"]))
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(text="erst"))


@query("f12_attachment_lists", "with {t}" + MAIL + " select id from mail where list_contains(exts, 'pdf')")
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(attachment_extension="pdf"))


@query("f10_attachment_name_list", "with {t}" + MAIL + " select id from mail where list_contains(names, 'file12.pdf')")
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(attachment_name="file12.pdf"))


@query("f10_attachment_name_word", "with {t}" + MAIL + " select id from mail where source_of = 'src3'")
def _(spark, d):
    return hits(mail(spark, d), MessageFilter(attachment_name="src3"))


def extracted(spark, d):
    """Attachments whose text is a document."""
    return texts(spark, d).select("id", "account_id", "mailbox_id", "subject", F.col("body").alias("text"), F.lit("").alias("name"), F.lit("").alias("sender"), "date", F.lit(0).alias("size"), F.lit(1).alias("page_count"), F.lit(None).cast("array<string>").alias("tags"))


@query("f20_attachment_text", "with {t} select id from texts where " + matches_sql("body", ["erst", "that"], fuzzy=False) + " or " + matches_sql("subject", ["erst", "that"]))
def _(spark, d):
    return hits(extracted(spark, d), AttachmentFilter(text="erst that"))


@query("f21_attachment_subject", "with {t} select id from texts where " + matches_sql("subject", ["src7"]))
def _(spark, d):
    return hits(extracted(spark, d), AttachmentFilter(subject="src7"))


@query("f37_download_due", "with {m} select id, (id % 5 = 0 or 1000000000000 - date > 60000 and 1000000000000 - date > (case when id % 2 = 0 then 60 else 6000000 end) * cast(60000 as bigint)) as due from messages")
def _(spark, d):
    k = F.col("id")
    return messages(spark, d).select("id", filters.download_due(1_000_000_000_000, k % 5 == 0, F.col("date"), F.col("date"), F.when(k % 2 == 1, 6_000_000)).alias("due"))


@query("a05_top_terms_of_list", "with {m} select tag as value, count(*) as doc_count from messages group by 1 order by 2 desc, 1 limit 10")
def _(spark, d):
    return facets.top_terms(messages(spark, d).select(F.explode("tags").alias("value")), "value")


@query("a09_a15_accounts_and_bytes", "with {m} select distinct account_id from messages")
def _(spark, d):
    return messages(spark, d).select("account_id").distinct()


@query("p01_dashboard_rows", "with {m} select id, sender, date, size from messages order by size desc, id limit 10")
def _(spark, d):
    return messages(spark, d).select("id", "sender", "date", "size").orderBy(F.desc("size"), "id").limit(10)


@query("p05_minimal_accounts", "with {c} select account_id, email from accounts")
def _(spark, d):
    return accounts(spark, d).select("account_id", "email")


@query("p04_exists", "with {m} select count(*) > 0 as found from messages where account_id = 7 and message_id = 'm47'")
def _(spark, d):
    return entities.exists(messages(spark, d), (F.col("account_id") == 7) & (F.col("message_id") == "m47"))


@query("o11_visible", "select event_id as id from events where event_type = 'error' order by ts desc, event_id limit 50")
def _(spark, d):
    e = read(spark, d, "events").withColumnRenamed("event_id", "id")
    return maintain.visible(e, F.col("event_type") == "error", "ts").select("id")


@query("w07_session_history", "select n_nationkey, case when n_nationkey % 3 = 0 then 'new' when n_nationkey % 3 = 1 then 'new,a,b' else 'new,a,b' end as history from nation")
def _(spark, d):
    k = F.col("n_nationkey") % 3
    old = F.when(k == 1, F.array(F.lit("a"), F.lit("b"))).when(k == 2, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return read(spark, d, "nation").select("n_nationkey", F.array_join(maintain.push_history(old, F.lit("new"), 3), ",").alias("history"))


@query("w08_keep_recent", "select event_id as id from events order by ts desc, event_id limit 75")
def _(spark, d):
    return maintain.keep_recent(read(spark, d, "events").withColumnRenamed("event_id", "id"), "ts", 100).select("id")


@query("u01_union_of_addresses", "with {t}" + MAIL + " select id, list_sort(list_distinct(list_concat(tos, ccs))) as addresses from mail")
def _(spark, d):
    return mail(spark, d).select("id", F.array_sort(F.array_union("to", "cc")).alias("addresses"))


@query("u05_referenced_hashes", "with {m} select distinct content_hash from messages union select distinct 'a' || l_partkey from lineitem join orders on o_orderkey = l_orderkey")
def _(spark, d):
    lists = attachments(spark, d).groupBy(F.col("eid").alias("id")).agg(F.collect_set("content_hash").alias("attachment_content_hash"))
    return entities.referenced_hashes(messages(spark, d).join(lists, "id", "left"))


@query("c03_id_hash")
def _(spark, d):
    return texts(spark, d).select("id", C.id_hash(F.col("body")).alias("hash"))


@query("c12_c13_header_text", "select n_nationkey, 'Grüße ' || n_name as subject from nation")
def _(spark, d):
    raw = F.concat(F.lit("=?utf-8?q?Gr=C3=BC?= =?utf-8?q?=C3=9Fe?= "), F.col("n_name"))
    return read(spark, d, "nation").select("n_nationkey", mime.header_text(raw).alias("subject"))


@query("c14_parsed_messages", "select conv_id, turn, role || '@example.com' as sender, 'Turn ' || turn as subject, sha256('AB' || turn) as attachment_hash from conversations")
def _(spark, d):
    turn = F.col("turn").cast("string")
    raw = F.concat(F.lit("From: <"), F.col("role"), F.lit("@Example.com>\r\nSubject: Turn "), turn, F.lit("\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\n"), F.lit("words\r\n--B\r\nContent-Disposition: attachment; filename=x.bin\r\n\r\nAB"), turn, F.lit("\r\n--B--\r\n"))
    m = read(spark, d, "conversations").select("conv_id", "turn", mime.parse_message(raw.cast("binary")).alias("m"))
    return m.select("conv_id", "turn", F.col("m.sender").alias("sender"), F.col("m.subject").alias("subject"), F.col("m.attachments")[0]["content_hash"].alias("attachment_hash"))


@query("x06_cursors", "select n_nationkey, case when n_nationkey % 2 = 0 then 4 else 1 end as first_uid from nation")
def _(spark, d):
    """Cursors of mailboxes: those of another validity start again from the first uid."""
    valid, highest = decode_cursor(encode_cursor(0, 3))
    return read(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == valid, highest + 1).otherwise(1).alias("first_uid"))


@query("x_windows_sliding", """select epoch_ms(w) as start_ms, event_type, count(*) as n from events, lateral (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w) group by 1, 2""")
def _(spark, d):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(read(spark, d, "events"), "1 hour", "30 minutes").select(ms("start").alias("start_ms"), "event_type", "n")
