"""The driver's tables seen as messages, attachments, accounts and mailboxes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, terms
from ..session import new_dir

MESSAGES_SQL = """messages as (select o_orderkey as id, o_custkey % 40 as account_id, o_orderstatus as mailbox_id, o_orderkey as uid,
  concat('user', cast(o_custkey % 500 as varchar), '@example.com') as sender, epoch_ms(o_orderdate) as date,
  case when o_orderkey % 13 = 0 then 0 else epoch_ms(o_orderdate) + (o_orderkey % 7 - 3) * 3600000 end as internal_date,
  epoch_ms(o_orderdate) + (o_orderkey % 11) * 60000 as ingest_at, cast(floor(o_totalprice) as bigint) as size, o_custkey as thread_id,
  o_orderkey % 4 as regular_attachment_count, concat('h', cast(o_custkey % 997 as varchar)) as content_hash,
  case when o_orderkey % 17 = 0 then '' else concat('m', cast(o_orderkey % 5000 as varchar)) end as message_id,
  concat('/', replace(o_orderpriority, '-', '/')) as tag from orders)"""
ATTACHMENTS_SQL = """attachments as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as eid, l_suppkey % 40 as account_id, concat('a', cast(l_partkey as varchar)) as content_hash,
  cast(floor(l_extendedprice) as bigint) as size, concat('file', cast(l_partkey % 300 as varchar), case l_returnflag when 'A' then '.pdf' when 'N' then '.PNG' else '' end) as name,
  case l_returnflag when 'A' then 'pdf' when 'N' then 'png' end as attachment_ext, l_linestatus as attachment_category, epoch_ms(l_shipdate) as date,
  l_linenumber as page_count, l_returnflag = 'R' as is_message from lineitem)"""
TEXTS_SQL = """texts as (select doc_id as id, doc_id % 40 as account_id, source as mailbox_id, concat_ws(' ', source, lang) as subject, text as body, doc_id * 1000 as date from documents)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"), (cust % 40).alias("account_id"), F.col("o_orderstatus").alias("mailbox_id"), key.alias("uid"),
        F.concat(F.lit("user"), (cust % 500).cast("string"), F.lit("@example.com")).alias("sender"), ms("o_orderdate").alias("date"),
        F.when(key % 13 == 0, F.lit(0)).otherwise(ms("o_orderdate") + (key % 7 - 3) * 3_600_000).cast("long").alias("internal_date"),
        (ms("o_orderdate") + (key % 11) * 60_000).alias("ingest_at"), F.floor("o_totalprice").cast("long").alias("size"), cust.alias("thread_id"),
        (key % 4).alias("regular_attachment_count"), F.concat(F.lit("h"), (cust % 997).cast("string")).alias("content_hash"),
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("m"), (key % 5000).cast("string"))).alias("message_id"),
        F.array(F.concat(F.lit("/"), F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("/")))).alias("tags"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("eid"), (F.col("l_suppkey") % 40).alias("account_id"),
        F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("content_hash"), F.floor("l_extendedprice").cast("long").alias("size"),
        F.concat(F.lit("file"), (F.col("l_partkey") % 300).cast("string"), F.when(flag == "A", ".pdf").when(flag == "N", ".PNG").otherwise("")).alias("name"),
        F.when(flag == "A", "pdf").when(flag == "N", "png").alias("attachment_ext"), F.col("l_linestatus").alias("attachment_category"),
        ms("l_shipdate").alias("date"), F.col("l_linenumber").alias("page_count"), (flag == "R").alias("is_message"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("account_id"), F.col("source").alias("mailbox_id"), F.concat_ws(" ", "source", "lang").alias("subject"), F.col("text").alias("body"), (F.col("doc_id") * 1000).alias("date"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer, under even numbers, so that messages of odd accounts are orphans."""
    key = F.col("c_custkey") * 2
    return read(spark, sf_dir, "customer").select(key.alias("account_id"), F.concat(F.lit("acc"), key.cast("string"), F.lit("@example.com")).alias("email"), F.col("c_nationkey").alias("created_by"))


ACCOUNTS_SQL = """accounts as (select c_custkey * 2 as account_id, concat('acc', cast(c_custkey * 2 as varchar), '@example.com') as email, c_nationkey as created_by from customer)"""


_stored: dict[tuple[str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, tag: str, write) -> str:
    """The folder of what ``write(path)`` derives from the tables in ``sf_dir``, written once for each application, as an ingest would."""
    key = spark.sparkContext.applicationId, f"{tag} {sf_dir}"
    if key not in _stored:
        path = new_dir(spark, tag)
        write(path)
        _stored[key] = path
    return _stored[key]


def text_terms(spark: SparkSession, sf_dir: str) -> terms.TermIndex:
    """The stored terms of ``texts``: words of subject and body, grams of the subject."""
    rows = lambda: terms.term_rows(texts(spark, sf_dir), ["subject", "body"], ["subject"])
    return terms.TermIndex(spark, once(spark, sf_dir, "terms", lambda path: terms.write(rows(), path, "overwrite")))


#: Days in a folder of the stored messages: the tables are small.
DAYS = 60


def stored_messages(spark: SparkSession, sf_dir: str, what, accounts=None) -> DataFrame:
    """The hits of a filter among the messages stored by time."""
    path = once(spark, sf_dir, "messages", lambda path: layout.write_by_day(messages(spark, sf_dir), path, DAYS))
    return layout.read_by_day(spark, path, what, accounts, DAYS)
