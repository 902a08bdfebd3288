"""Time layout, rebuilds, header repair, event kinds, duplicates after a stored table, hot keys and natural order."""

import json

import pytest
from pyspark.sql import functions as F

from courierlake.functions.scalars import DAY_MS
from courierlake.operators import access, entities, layout, maintain, rebuild
from courierlake.operators.filters import MessageFilter
from courierlake.sources import mail
from courierlake.streaming import audit, ingest

KIND = "id long, account_id long, mailbox_id long, date long, internal_date long, ingest_at long, size long, tags array<string>"


def test_time_layout_prunes_and_replaces_days(spark, tmp_path):
    rows = [(i, 1, 1, None if i == 7 else i * DAY_MS // 4, i, i, i, None) for i in range(60)]
    df, path = spark.createDataFrame(rows, KIND), str(tmp_path / "m")
    layout.write_by_day(df, path)
    what = MessageFilter(since=3 * DAY_MS, before=5 * DAY_MS)
    found = layout.read_by_day(spark, path, what)
    assert sorted(r.id for r in found.collect()) == list(range(12, 21)) and found.columns == df.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(day#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(date," in plan.split("PushedFilters: [")[1]
    again = df.where(f"date >= {3 * DAY_MS} and date < {4 * DAY_MS}").withColumn("size", F.lit(99).cast("long"))
    layout.write_by_day(again, path)  # one day again: the others stay
    sizes = {r.id: r.size for r in spark.read.parquet(path).collect()}
    assert len(sizes) == 60 and all(sizes[i] == (99 if 12 <= i < 16 else i) for i in sizes)
    assert sorted(r.id for r in layout.read_by_day(spark, path, MessageFilter()).collect()) == list(range(60))


def test_rebuild_tells_what_it_leaves(spark, tmp_path):
    good = [json.dumps({"id": i, "size": i, "name": f"n{i}"}) for i in range(20)]
    bad = ['{"id": 1, "size"', "", "null", "[1]", '{"size": 3}', '{"id": 4, "size": "many"}', None, '{"id": 90, "size": -1}']
    stored = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(good + bad)], "place string, raw string").repartition(4)
    kind, rules = "id bigint, size bigint, name string", {"negative_size": F.col("row.size") < 0}
    path = str(tmp_path / "new")
    assert rebuild.rebuild(spark, stored, kind, path, rules=rules) == {"read": 28, "rows": 20, "skipped": 8}
    assert sorted(tuple(r) for r in rebuild.rebuilt(spark, path).collect()) == [(i, i, f"n{i}") for i in range(20)]
    told = {r.place: (r.raw, r.reason) for r in rebuild.skip_report(spark, path).collect()}
    unread = "unreadable_document"
    assert told == {f"s{20 + i}": (x, why) for i, (x, why) in enumerate(zip(bad, (unread, unread, unread, unread, "missing_id", unread, unread, "negative_size")))}
    twice = stored.where("place in ('s1', 's2')").union(stored.where("place = 's2'"))
    with pytest.raises(ValueError, match="more than once"):
        rebuild.rebuild(spark, twice, kind, str(tmp_path / "twice"))


def test_headers_are_repaired_from_raw_messages(spark):
    raw = lambda subject, name, body: (f"Subject: {subject}\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nx\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"{name}\"\n\n{body}\n--b--\n").encode()
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    gbk = "=?gbk?b?" + __import__("base64").b64encode("你好".encode("gbk")).decode() + "?="
    rows = [
        (1, "h1", "��", [("�.txt", sha("one"))]), (2, "h2", "", [("fine.txt", sha("two"))]), (3, "h3", "fine", [("fine.txt", sha("three"))]), (4, "missing", "�", None),
        (5, "h5", "�", [(None, "other"), ("�", "unknown")]), (6, None, None, []), (7, "h1", "��", [("�.txt", sha("one"))]),
    ]
    messages = spark.createDataFrame(rows, "id long, content_hash string, subject string, attachments array<struct<filename:string,content_hash:string>>")
    raws = spark.createDataFrame([("h1", raw(gbk, gbk, "one")), ("h2", raw("plain", "new.txt", "two")), ("h3", raw("other", "other", "three")), ("h5", raw("", "x", "y")), ("h1", raw(gbk, gbk, "one"))], "content_hash string, raw binary")
    found = rebuild.repair_headers(messages, raws)
    got = {r.id: (r.subject, [a.filename for a in r.attachments or []], r.repaired) for r in found.collect()}
    assert got == {1: ("你好", ["你好"], True), 2: ("plain", ["fine.txt"], True), 3: ("fine", ["fine.txt"], False), 4: ("�", [], False), 5: ("�", [None, "�"], False), 6: (None, [], False), 7: ("你好", ["你好"], True)}
    parts = spark.createDataFrame([(1, sha("one"), "��", "�.txt"), (3, sha("three"), "fine", "fine.txt"), (2, sha("two"), "", "fine.txt")], "eid long, content_hash string, subject string, name string")
    assert sorted(tuple(r) for r in rebuild.repair_attachments(parts, found).select("eid", "subject", "name").collect()) == [(1, "你好", "你好"), (2, "plain", "fine.txt"), (3, "fine", "fine.txt")]


def test_each_kind_of_event_has_its_entry(spark):
    props = {"user": "u", "reset_by": "r", "created_by": "c", "updated_by": "p", "removed_by": "m", "target_user": "t", "new_user": "n", "role_name": "role", "email_id": "e", "account": "a", "ip": "1.2.3.4", "success": "true", "status": "repaired", "deleted": "3", "window_days": "30", "content_hash": "h", "query": "q", "key": "k"}
    rows = [(i, 5, kind, json.dumps(props)) for i, kind in enumerate([*audit.KINDS, "Other"])] + [(90, 5, "UserLoggedIn", '{"user": "u"}'), (91, 5, "EmailRepaired", '{"status": "failed"}'), (92, 5, "BackupCreated", "damaged"), (93, None, None, None)]
    got = {int(r.key.split("-")[1]): tuple(r)[2:] for r in audit.entries(spark.createDataFrame(rows, "event_id long, ts_ms long, kind string, props string")).collect()}
    want = [
        ("u", "user.login", None, "1.2.3.4", None, True), ("u", "user.login", None, "1.2.3.4", "mfa", True), ("u", "mfa.enabled", None, "1.2.3.4", None, True), ("u", "mfa.disabled", None, "1.2.3.4", None, True),
        ("r", "mfa.reset", "t", "1.2.3.4", None, True), ("c", "user.created", "n", None, None, True), ("p", "user.updated", "t", None, None, True), ("m", "user.removed", "t", None, None, True),
        ("c", "role.created", "role", None, None, True), ("p", "role.updated", "role", None, None, True), ("m", "role.removed", "role", None, None, True), ("u", "email.viewed", "e", "1.2.3.4", None, True),
        ("u", "email.deleted", "e", None, None, True), ("u", "email.repaired", "e", None, "repaired", True), ("system", "email.retention_purged", "a", None, "deleted=3 window_days=30", True),
        ("u", "attachment.downloaded", "e", None, "h", True), ("u", "search.performed", None, None, "q", True), ("u", "settings.changed", None, None, "k", True), ("u", "backup.created", None, None, None, True),
        ("u", "backup.restore_staged", None, None, None, True),
    ]
    assert [got[i] for i in range(20)] == want and 20 not in got and 93 not in got
    assert got[90] == ("u", "user.login", None, None, None, False) and got[91] == (None, "email.repaired", None, None, "failed", False) and got[92] == (None, "backup.created", None, None, None, True)


def test_a_stream_on_a_filled_table_is_restarted(spark, tmp_path):
    kind = "account_id long, mailbox_id long, content_hash string, ingest_ts timestamp"
    rows = lambda *hashes: spark.createDataFrame([(1, 1, h) for h in hashes], "account_id long, mailbox_id long, content_hash string").withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp"))
    came, out, state = (str(tmp_path / x) for x in ("came", "out", "state"))
    stored = rows("a", "b")
    for batch, want in ((("a", "c", "c"), ["c"]), (("c", "b", "d"), ["c", "d"]), (("d", "e", "a"), ["c", "d", "e"])):
        rows(*batch).coalesce(1).write.mode("append").parquet(came)
        stream = spark.readStream.schema(kind).parquet(came)
        ingest.start(ingest.first_copies_after(stream, stored), ingest.append_once(out), state).awaitTermination()
        assert sorted(r.content_hash for r in spark.read.parquet(out).collect()) == want


def test_a_body_that_most_messages_carry(spark):
    import hashlib

    body = b"bG9nbw=="
    h = hashlib.sha256(body).hexdigest()
    rows = [(i, f"x [detached:{h if i % 3 else '0' * 64}] y".encode()) for i in range(300)] + [(300, b"none"), (301, None)]
    bodies = spark.createDataFrame([(h, body), (h, body)], "content_hash string, body binary")
    got = {r.id: r.raw and bytes(r.raw) for r in maintain.reattach_parts(spark.createDataFrame(rows, "id long, raw binary"), bodies).collect()}
    assert all(got[i] == (b"x " + body + b" y" if i % 3 else rows[i][1]) for i in range(300)) and got[300] == b"none" and got[301] is None


def test_grants_are_bounded(spark):
    users = spark.createDataFrame([(1, {5: 1}), (2, None)], "user_id long, account_access map<bigint,bigint>")
    ask = lambda *a: spark.createDataFrame([(x,) for x in a], "account_id long")
    got = {r.user_id: r.account_access for r in access.grant(users, ask(5, 6, 6, None), 9).collect()}
    assert got == {1: {5: 9, 6: 9}, 2: {5: 9, 6: 9}}
    assert {r.user_id: r.account_access for r in access.grant(users, ask(), 9).collect()} == {1: {5: 1}, 2: None}
    with pytest.raises(Exception, match="more than 2 accounts"):
        access.grant(users, ask(1, 2, 3), 9, most=2).collect()


def test_folders_in_natural_order(spark):
    names = ["a10", "a2", "A2/b", "a2 x", "b", "a02", "B/1/10", "b/1/9", "b/" + "9" * 25, "é"]
    tree = entities.folder_tree(spark.createDataFrame([(n,) for n in names], "name string")).orderBy("sort_key", "path")
    assert [r.path for r in tree.collect()] == ["A2", "a02", "a2", "A2/b", "a2 x", "a10", "B", "b", "B/1", "b/1", "b/1/9", "B/1/10", "b/" + "9" * 25, "é"]


def test_strict_lookups_fail_for_what_is_missing(spark):
    m = spark.createDataFrame([(1, 1, 1), (2, 9, 1)], "id long, account_id long, mailbox_id long")
    a, b = spark.createDataFrame([(1, "x@y")], "account_id long, account_email string"), spark.createDataFrame([(1, "box")], "mailbox_id long, mailbox_name string")
    assert [r.id for r in entities.enrich(m, a, b).collect()] == [1]
    with pytest.raises(Exception, match="account_email is missing"):
        entities.enrich(m, a, b, strict=True).collect()


def test_batches_are_numbered_from_the_end(spark):
    import base64

    eml = base64.b64encode(b"Subject: s\n\nx").decode()
    got = mail.read_base64(spark.createDataFrame([("a", 1, eml), ("a", 2, "***"), ("b", 1, None)], "batch string, at long, eml string"), batch="batch", at="at").collect()
    assert sorted((r.batch, r["at"], r.from_end, r.message and r.message.subject) for r in got) == [("a", 1, 2, "s"), ("a", 2, 1, None), ("b", 1, 1, None)]
