"""Queries of filters, sorting, paging and full-text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import access, filters, search
from ..operators.filters import AttachmentFilter, FilterRule, MessageFilter
from .registry import query
from .tables import accounts, attachments, messages, ms, read, stored_messages, text_terms, texts

JAN_96, JAN_97 = 820454400000, 852076800000
M = "with {m} select id from messages where "
A = "with {a} select id from attachments where "
BETWEEN = f"between {JAN_96} and {JAN_97}"


def placed(page):
    """A page with the place of each row, as the page itself has them in order."""
    return page.withColumn("__at", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(Window.orderBy("__at"))).drop("__at")


def hits(df, what, scope=None):
    return df.where(what.column(scope)).select("id")


@query("search_page_date", "select o_orderkey as id, epoch_ms(o_orderdate) as date from orders order by o_orderdate desc, o_orderkey limit 20 offset 20")
def _(spark, d):
    return search.search(messages(spark, d), MessageFilter(), page=2, size=20).select("id", "date")


@query("f01_authorised_accounts", M + "account_id in (1, 2, 3)")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(), {1, 2, 3})


@query("f01_authorised_by_table", M + "account_id in (select c_custkey from customer where c_custkey < 40 and c_custkey % 2 = 0)")
def _(spark, d):
    return filters.authorised(messages(spark, d), accounts(spark, d)).select("id")


@query("f01_no_account", M + "false")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(), set())


@query("f05_tags_below", M + "tag = '/3' or tag like '/3/%' or tag like '/1/%' or tag = '/1' or (tag || '/') like '/3%' and split_part(substr(tag, 2), '/', 1) = '3'")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(tags=("/3", "/1")))


@query("f09_has_attachment", M + "regular_attachment_count >= 1")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(has_attachment=True))


@query("f09_no_attachment", M + "regular_attachment_count = 0")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(has_attachment=False))


@query("f11_message_id", M + "message_id = 'm77'")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(message_id="m77"))


@query("f13_date_range", M + f"date {BETWEEN}")
def _(spark, d):
    return stored_messages(spark, d, MessageFilter(since=JAN_96, before=JAN_97)).select("id")


@query("f14_internal_date_range", M + f"internal_date {BETWEEN}")
def _(spark, d):
    return stored_messages(spark, d, MessageFilter(internal_date_since=JAN_96, internal_date_before=JAN_97)).select("id")


@query("f15_ingest_range", M + f"ingest_at {BETWEEN}")
def _(spark, d):
    return stored_messages(spark, d, MessageFilter(ingest_since=JAN_96, ingest_before=JAN_97)).select("id")


@query("f16_f17_accounts_and_mailboxes", M + "account_id in (3, 5, 7) and mailbox_id = 'F'")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(account_ids=(3, 5, 7), mailbox_ids=("F",)))


@query("f18_size_range", M + "size between 10000 and 50000")
def _(spark, d):
    return hits(messages(spark, d), MessageFilter(min_size=10_000, max_size=50_000))


@query("f22_attachment_hash", A + "content_hash = 'a7'")
def _(spark, d):
    return hits(attachments(spark, d), AttachmentFilter(content_hash="a7"))


FOLD_NAME = "strip_accents(lower(name))"


@query("f23_attachment_name", A + f"""name = 'file12.pdf' or (' ' || array_to_string(regexp_extract_all({FOLD_NAME}, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ') like '% file12 pdf %'
  or (select count(*) from (select distinct unnest(['fil','ile','le1','e12','12.','2.p','.pd','pdf']) as g) where contains({FOLD_NAME}, g)) >= 7""")
def _(spark, d):
    return hits(attachments(spark, d), AttachmentFilter(attachment_name="file12.pdf"))


@query("f24_attachment_kind", A + "attachment_ext = 'png' and attachment_category = 'O'")
def _(spark, d):
    return hits(attachments(spark, d), AttachmentFilter(attachment_extension="png", attachment_category="O"))


@query("f25_f26_attachment_flags", A + f"is_message and date {BETWEEN} and size >= 1000 and account_id in (1, 2)")
def _(spark, d):
    return hits(attachments(spark, d), AttachmentFilter(is_message=True, since=JAN_96, before=JAN_97, min_size=1000, account_ids=(1, 2)))


@query("f27_page_count", A + "page_count between 2 and 4")
def _(spark, d):
    return hits(attachments(spark, d), AttachmentFilter(min_page_count=2, max_page_count=4))


@query("f30_retention_expired", M + f"(date > 0 and date < {JAN_96}) or (internal_date > 0 and internal_date < {JAN_96})")
def _(spark, d):
    return messages(spark, d).where(filters.retention_expired(JAN_96)).select("id")


@query("f31_effective_date", "with {m} select id, least(nullif(date, 0), nullif(internal_date, 0)) as effective from messages")
def _(spark, d):
    from ..functions.scalars import effective_date

    return messages(spark, d).select("id", effective_date(F.col("date"), F.col("internal_date")).alias("effective"))


@query("f32_filter_rules", M + "(lower(sender) = 'user7@example.com' or regexp_matches(sender, 'user1[0-9]+@')) and not regexp_matches(sender, '5@')")
def _(spark, d):
    rule = FilterRule(include=("USER7@example.com",), include_patterns=("user1[0-9]+@",), exclude_patterns=("5@",))
    return messages(spark, d).where(rule.column(F.col("sender"))).select("id")


@query("f33_should_archive", M + "regexp_matches(sender, '1') and not size > 200000 and message_id <> 'm9'")
def _(spark, d):
    held = messages(spark, d).withColumn("subject", F.col("message_id")).withColumn("spam", F.lit(None).cast("string"))
    rule = filters.should_archive(True, FilterRule(include_patterns=("1",)), FilterRule(exclude=("M9",)), 200_000, True)
    return held.where(rule).select("id")


@query("f34_should_extract", A + "attachment_ext = 'pdf' and not contains(name, '7')")
def _(spark, d):
    held = attachments(spark, d).where("attachment_ext is not null")
    return held.where(filters.should_extract(True, {"attachment_ext": FilterRule(include=("PDF",)), "name": FilterRule(exclude_patterns=("7",))})).select("id")


@query("f35_should_try_extract", A + "attachment_ext = 'pdf' and size <= 10485760")
def _(spark, d):
    return attachments(spark, d).where(filters.should_try_extract(F.col("attachment_ext"), F.lit(None).cast("string"), F.col("size"))).select("id")


@query("f36_before_day", "select o_orderkey as id from orders where cast(o_orderdate as date) < date '1995-03-15'")
def _(spark, d):
    return read(spark, d, "orders").where(filters.before_day(F.col("o_orderdate"), "1995-03-15")).select(F.col("o_orderkey").alias("id"))


def _people(spark, d):
    """Users and roles made from nations: every fifth user is an administrator; roles differ by region."""
    users = read(spark, d, "nation").select(
        F.col("n_nationkey").alias("user_id"), (F.col("n_nationkey") % 5 == 0).alias("is_admin"), F.array(F.col("n_regionkey")).alias("global_roles"),
        F.create_map(F.col("n_nationkey").cast("long"), F.lit(10)).alias("account_access"),
    )
    rules = {0: ["data:read:all"], 1: ["account:manage:all"], 2: ["data:read"], 10: ["account:manage"]}
    roles = spark.createDataFrame([(k, v) for k, v in rules.items()], "role_id int, permissions array<string>")
    return users, roles


@query("f38_has_permission", """select n_nationkey as user_id, cast(1 as bigint) as account_id, (n_nationkey % 5 = 0 or n_regionkey in (0, 2) or n_nationkey = 1) as allowed from nation""")
def _(spark, d):
    users, roles = _people(spark, d)
    asked = users.select("user_id", F.lit(1).cast("long").alias("account_id"))
    return access.has_permission(asked, users, roles, "data:read")


@query("f39_search_scope", M + "account_id = 4")
def _(spark, d):
    users, roles = _people(spark, d)
    return filters.authorised(messages(spark, d), access.search_scope(4, users, roles, "data:export:batch:all")).select("id")


@query("f40_mailbox_and_thread", M + "account_id = 7 and mailbox_id = 'O' or account_id = 7 and thread_id = 47")
def _(spark, d):
    m = messages(spark, d)
    return m.where("account_id = 7 and mailbox_id = 'O'").union(m.where("account_id = 7 and thread_id = 47")).distinct().select("id")


FOLD = "replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
SEQ = "(' ' || array_to_string(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: case when length(x) < 41 then " + FOLD.format("x") + " else '' end), lambda x: x <> ''), ' ') || ' ')"


@query("t01_tokens", "with {t} select id, len(list_filter(regexp_extract_all(body, '[\\p{L}\\p{N}]+'), lambda x: length(x) < 41)) as n, md5(" + SEQ.format("body") + ") as hash from texts")
def _(spark, d):
    t = texts(spark, d)
    return t.select("id", F.size(X.tokens(F.col("body"))).alias("n"), F.md5(X.sequence_text(F.col("body"))).alias("hash"))


@query("t03_fold", "with {t} select id, " + "md5(" + FOLD.format("body") + ") as folded from texts")
def _(spark, d):
    return texts(spark, d).select("id", F.md5(X.fold(F.col("body"))).alias("folded"))


@query("search_text_and", "with {t} select id from texts where contains(" + SEQ.format("body") + ", ' und ') and contains(" + SEQ.format("body") + ", ' der ')")
def _(spark, d):
    """From the stored terms: the files of two words."""
    return text_terms(spark, d).matches("Und der", ["body"])


@query("search_text_or_not", "with {t} select id from texts where (contains(" + SEQ.format("body") + ", ' que ') and not contains(" + SEQ.format("body") + ", ' una ')) or contains(" + SEQ.format("body") + ", ' the and ')")
def _(spark, d):
    return texts(spark, d).where(filters.words_or_grams('que -una OR "the and"', ["body"])).select("id")


@query("t10_phrase", "with {t} select id from texts where contains(" + SEQ.format("body") + ", ' of the ')")
def _(spark, d):
    return texts(spark, d).where(X.word_match([X.sequence_text(F.col("body"))], '"of the"')).select("id")


GRAM = "replace(replace(replace(substr(s, i, 3), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
GRAMS = "list_distinct(list_transform(range(1, greatest(len(s) - 1, 1)), lambda i: " + GRAM + "))"


@query("t04_trigrams", "with {t}, f as (select id, strip_accents(lower(body)) as s from texts) select id, len(" + GRAMS + ") as n from f")
def _(spark, d):
    return texts(spark, d).select("id", F.size(X.grams(F.col("body"))).alias("n"))


@query("search_trigram", "with {t}, f as (select id, strip_accents(lower(body)) as s from texts), g as (select id, " + GRAMS + " as l from f) select id from g where len(list_intersect(l, ['eau','aut','uti','tio','ion'])) >= 4")
def _(spark, d):
    return texts(spark, d).where(X.fuzzy_match([X.gram_text(F.col("body"))], "eaution")).select("id")


@query("t08_word_or_fuzzy", "with {t}, f as (select id, strip_accents(lower(body)) as s, " + SEQ.format("body") + " as q from texts), g as (select id, q, " + GRAMS + " as l from f) select id from g where contains(q, ' thion ') or len(list_intersect(l, ['thi','hio','ion'])) >= 2")
def _(spark, d):
    return texts(spark, d).where(filters.words_or_grams("thion", ["body"], ["body"])).select("id")


@query("rank_bm25", "with {t}, k as (select id, list_filter(list_transform(regexp_extract_all(body, '[\\p{L}\\p{N}]+'), lambda x: case when length(x) < 41 then " + FOLD.format("x") + """ else '' end), lambda x: x <> '') as l from texts),
  c as (select id, len(l) as n, len(list_filter(l, lambda x: x = 'the')) as a, len(list_filter(l, lambda x: x = 'erst')) as b from k),
  s as (select count(*)::double as alls, avg(n) as mean, count(*) filter (a > 0)::double as da, count(*) filter (b > 0)::double as db from c)
  select id, round(case when a > 0 then ln(1 + (alls - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) else 0 end
    + case when b > 0 then ln(1 + (alls - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) else 0 end, 6) as score from c, s""")
def _(spark, d):
    return search.bm25(texts(spark, d).select("id"), "the erst", {"body": 1.0}, index=text_terms(spark, d)).select("id", F.round("score", 6).alias("score"))


def seen(spark, d):
    """Texts with the columns that filters beside the stored terms look at."""
    numbers = [F.lit(0).cast("long").alias(c) for c in ("internal_date", "ingest_at", "size", "regular_attachment_count")]
    return texts(spark, d).select("id", "account_id", "mailbox_id", "date", *numbers, F.lit(None).cast("array<string>").alias("tags"))


def ranked_page(found):
    """A page of the best hits with their places, which stand for the order."""
    return found.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("position"), "id", F.round("score", 6).alias("score"))


WORDS_OF = "list_filter(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda x: case when length(x) < 41 then " + FOLD.format("x") + " else '' end), lambda x: x <> '')"
COUNT = "len(list_filter({0}, lambda x: x = '{1}'))"
PART = "{w} * ln(1 + (alls - d{i} + 0.5) / (d{i} + 0.5)) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * n{i} / m{i}))"
_scored = [("lb", "the", 1.0), ("ls", "src7", 3.0), ("gs", "src", 1.0), ("gs", "rc7", 1.0)]


@query("search_relevance_fields", "with {t}, k as (select id, " + WORDS_OF.format("body") + " as lb, " + WORDS_OF.format("subject") + """ as ls, list_transform(range(1, greatest(length(subject) - 1, 1)), lambda i: substr(lower(subject), i, 3)) as gs from texts),
  c as (select id, """ + ", ".join(f"{COUNT.format(l, t)} as c{i}, len({l}) as n{i}" for i, (l, t, _) in enumerate(_scored)) + """ from k),
  s as (select count(*)::double as alls, """ + ", ".join(f"count(*) filter (c{i} > 0)::double as d{i}, avg(n{i}) as m{i}" for i in range(4)) + """ from c),
  r as (select id, """ + " + ".join(f"case when c{i} > 0 then {PART.format(w=w, i=i)} else 0 end" for i, (_, _, w) in enumerate(_scored)) + """ as score from c, s where c0 > 0 and (c1 > 0 or c2 > 0 and c3 > 0))
  select row_number() over (order by round(score, 6) desc, id) as position, id, round(score, 6) as score from r order by round(score, 6) desc, id limit 40""")
def _(spark, d):
    """Subject and body together: words of the subject weigh three, its grams one, words of the body one."""
    what = MessageFilter(subject="src7", body="the")
    found = search.search(seen(spark, d), what, sort_by="RELEVANCE", size=500, index=text_terms(spark, d)).withColumn("score", F.round("score", 6))
    return ranked_page(search.sorted_page(found, "score", 1, 40))


@query("search_relevance", "with {t}, k as (select id, list_filter(list_transform(regexp_extract_all(body, '[\\p{L}\\p{N}]+'), lambda x: case when length(x) < 41 then " + FOLD.format("x") + """ else '' end), lambda x: x <> '') as l from texts where id % 40 < 20),
  c as (select id, len(l) as n, len(list_filter(l, lambda x: x = 'the')) as a, len(list_filter(l, lambda x: x = 'that')) as b from k),
  s as (select count(*)::double as alls, avg(n) as mean, count(*) filter (a > 0)::double as da, count(*) filter (b > 0)::double as db from c),
  r as (select id, ln(1 + (alls - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (alls - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) as score from c, s where a > 0 and b > 0)
  select row_number() over (order by score desc, id) as position, id, round(score, 6) as score from r order by score desc, id limit 30""")
def _(spark, d):
    """Ranked among all rows of the accounts that may be seen; the position stands for the order."""
    return ranked_page(search.search(seen(spark, d), MessageFilter(body="the that"), accounts=set(range(20)), sort_by="RELEVANCE", size=30, index=text_terms(spark, d)))


@query("t12_facet_prefixes", "with {m}, p as (select id, string_split(substr(tag, 2), '/') as l from messages) select id, '/' || array_to_string(l[1:i], '/') as path from p, lateral (select unnest(range(1, len(l) + 1)) as i)")
def _(spark, d):
    return messages(spark, d).select("id", F.explode(X.facet_prefixes(F.col("tags"))).alias("path"))


@query("o01_sort_by_size", "with {m} select cast(row_number() over (order by size, id) as integer) as position, id, size from messages order by size, id limit 50")
def _(spark, d):
    return placed(search.search(messages(spark, d), MessageFilter(), sort_by="SIZE", descending=False, size=50).select("id", "size"))


@query("o01_sort_by_internal_date", "with {m} select cast(row_number() over (order by internal_date desc, id) as integer) as position, id, internal_date from messages where account_id = 3 order by internal_date desc, id limit 20")
def _(spark, d):
    return placed(search.search(messages(spark, d), MessageFilter(account_ids=(3,)), sort_by="INTERNAL_DATE").select("id", "internal_date"))


@query("o02_relevance_without_text", "with {m} select cast(row_number() over (order by date desc, id) as integer) as position, id from messages order by date desc, id limit 20")
def _(spark, d):
    return placed(search.search(messages(spark, d), MessageFilter(), sort_by="RELEVANCE").select("id"))


@query("o03_attachments_by_internal_date", "with {a} select cast(row_number() over (order by date desc, id) as integer) as position, id, date from attachments order by date desc, id limit 20")
def _(spark, d):
    return placed(search.search(attachments(spark, d), AttachmentFilter(), sort_by="INTERNAL_DATE").select("id", "date"))


@query("o04_page_info", "with {m} select 3 as current_page, 25 as page_size, count(*) as total_items, cast(ceil(count(*) / 25.0) as bigint) as total_pages from messages where account_id = 5")
def _(spark, d):
    return search.page_info(messages(spark, d).where("account_id = 5"), 3, 25)


@query("thread_page", "select cast(row_number() over (order by turn desc) as integer) as position, conv_id, turn, role from conversations where conv_id = 3")
def _(spark, d):
    c = read(spark, d, "conversations").withColumn("account_id", F.lit(1)).withColumn("id", F.col("turn")).withColumn("date", F.col("turn")).withColumn("thread_id", F.col("conv_id"))
    return placed(search.thread(c, 1, 3).select("conv_id", "turn", "role"))


@query("o06_largest_messages", "with {m} select cast(row_number() over (order by size desc, id) as integer) as position, id, size from messages order by size desc, id limit 10")
def _(spark, d):
    return placed(search.sorted_page(messages(spark, d), "size", 1, 10).select("id", "size"))


@query("o07_o08_key_page", "select cast(row_number() over (order by cast(n_nationkey as varchar)) - 10 as integer) as position, n_nationkey, n_name from nation order by cast(n_nationkey as varchar) limit 5 offset 10")
def _(spark, d):
    return placed(search.key_page(read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey"), 3, 5))


@query("o09_account_list", "select c_custkey as id, epoch_ms(timestamp '2024-01-01') + c_custkey % 7 as created_at from customer")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(1704067200000) + F.col("c_custkey") % 7).alias("created_at"))
    return search.account_list(c, admin=False)


@query("o09_account_page_admin", "select cast(row_number() over (order by cast(c_custkey as varchar)) as integer) - 50 as position, c_custkey as id from customer order by cast(c_custkey as varchar) limit 50 offset 50")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("created_at"))
    return placed(search.account_list(c, admin=True, page=2, size=50)).select("position", "id")


@query("o09_account_page_user", "select cast(row_number() over (order by c_custkey % 7 desc, c_custkey) as integer) - 50 as position, c_custkey as id from customer order by c_custkey % 7 desc, c_custkey limit 50 offset 50")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("created_at"))
    return placed(search.account_list(c, admin=False, page=2, size=50)).select("position", "id")


@query("s04_key_page", "select cast(row_number() over (order by c_name desc) as integer) - 20 as position, c_name as key, c_custkey as value from customer order by c_name desc limit 20 offset 20")
def _(spark, d):
    """A page of the keys of a store from the end."""
    c = read(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))
    return placed(search.key_page(c, F.col("key"), 2, 20, descending=True)).select("position", "key", "value")


@query("search_page_placed", "select cast(row_number() over (order by o_orderdate desc, o_orderkey) as integer) - 20 as position, o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 20 offset 20")
def _(spark, d):
    """The page of ``search_page_date`` with the place of each row."""
    return placed(search.search(messages(spark, d), MessageFilter(), page=2, size=20)).select("position", "id")
