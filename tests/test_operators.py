"""Filters, lookups, maintenance and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from courierlake import schema
from courierlake.operators import entities, facets, maintain, search
from courierlake.operators.filters import AttachmentFilter, FilterRule, MessageFilter
from courierlake.streaming import changes, ingest


def messages(spark, *rows):
    base = {"account_id": 1, "mailbox_id": 1, "uid": 1, "subject": "", "body": "", "sender": "sender@example.com", "to": [], "cc": [], "bcc": [], "date": 0, "internal_date": 0, "ingest_at": 0, "size": 100, "attachment_name": [], "tags": None}
    kind = schema.struct(schema.MESSAGES)
    return spark.createDataFrame([tuple((base | r).get(f.name) for f in kind.fields) for r in rows], kind)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_address_filters(spark):
    df = messages(spark, {"id": "a", "sender": "alice@x.org", "to": ["bob@y.org"]}, {"id": "b", "sender": "carl@x.org", "cc": ["alice@x.org"], "attachment_name": ["Report 2024.pdf"]})
    hit = lambda **k: ids(df.where(MessageFilter(**k).column()))
    assert hit(sender="alice") == ["a"] and hit(to="bob@y.org") == ["a"] and hit(any_recipient="alice") == ["b"] and hit(any_participant="alice") == ["a", "b"]
    assert hit(attachment_name="report") == ["b"] and hit(text="carl") == ["b"] and hit(account_ids=()) == [] and hit(tags=()) == ["a", "b"]
    assert MessageFilter(text="x").has_text() and not MessageFilter(sender="x").has_text()


def test_relevance_order(spark):
    df = messages(spark, {"id": "best", "subject": "newsletter", "body": "newsletter newsletter"}, {"id": "passing", "subject": "hello", "body": "a long text that names the newsletter once " * 3})
    assert [r.id for r in search.by_relevance(df, "newsletter", {"subject": 1.0, "body": 1.0}, 1, 10).collect()] == ["best", "passing"]


def test_relevance_counts_all_rows(spark):
    rows = [{"id": f"c{i}", "body": "a common remark"} for i in range(50)] + [{"id": "x1", "body": "common common zebra and more words behind it"}, {"id": "x2", "body": "zebra common"}, {"id": "z", "body": "zebra zebra zebra common"}]
    df = messages(spark, *rows)
    found = search.search(df, MessageFilter(body="common zebra"), sort_by="RELEVANCE").collect()
    score = {r.id: r.score for r in found}
    assert [r.id for r in found] == ["z", "x2", "x1"] and score["z"] > 2 * search.bm25(df, "common", {"body": 1.0}).where("id = 'z'").first().score


def test_words_weigh_more_than_grams(spark):
    df = messages(spark, {"id": "fuzzy", "subject": "newsletters of may"}, {"id": "word", "subject": "newsletter of may"}, {"id": "name", "attachment_name": ["newsletter.pdf"]}, {"id": "other", "subject": "nothing"})
    found = search.search(df, MessageFilter(text="newsletter"), sort_by="RELEVANCE").collect()
    score = {r.id: r.score for r in found}
    assert set(score) == {"fuzzy", "word", "name"} and score["word"] > score["fuzzy"] > 0 and score["name"] > 0


def test_repeated_keys(spark):
    store = spark.createDataFrame([("a", 0), ("b", 0)], "key string, value int")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "key string, value int")
    assert sorted(map(tuple, maintain.kv_upsert(store, new, order="value").collect())) == [("a", 2), ("b", 0), ("c", 3)]
    for call in (maintain.kv_upsert, maintain.kv_insert, maintain.kv_update):
        with pytest.raises(Exception, match="key repeated|key exists|no such key"):
            call(store, new).collect()
    assert sorted(map(tuple, maintain.kv_update(store, new.where("value = 2")).collect())) == [("a", 2), ("b", 0)]


def test_invalid_patterns_match_nothing(spark):
    df = spark.createDataFrame([("ab",), ("cd",)], "v string")
    assert [r.v for r in df.where(FilterRule(include_patterns=("a(", "^c")).column(F.col("v"))).collect()] == ["cd"]
    assert df.where(FilterRule(exclude_patterns=("[",)).column(F.col("v"))).count() == 2


def test_pages(spark):
    df = spark.range(25)
    with pytest.raises(ValueError):
        search.page_bounds(0, 10)
    with pytest.raises(ValueError):
        search.page_bounds(1, 501)
    assert search.sorted_page(df, "id", 3, 10).count() == 5 and search.sorted_page(df, "id", 9, 10).count() == 0
    assert search.key_page(df, F.col("id")).count() == 25


def test_gap_fill(spark):
    remote = spark.createDataFrame([(1, "m1", 5, 7), (2, None, 5, 7), (3, "new", 9, 9), (4, None, 1, 1), (5, "other", 5, 7)], "uid int, message_id string, size int, internal_date int")
    local = spark.createDataFrame([("m1", 5, 7)], "message_id string, size int, internal_date int")
    assert sorted(r.uid for r in entities.missing_messages(remote, local).collect()) == [3, 4]


def test_dedup_and_replay(spark):
    m = spark.createDataFrame([("a", 1, 1, "h", 1), ("b", 1, 1, "h", 2), ("c", 1, 2, "h", 1), ("d", 1, 1, "h", 2)], "id string, account_id int, mailbox_id int, content_hash string, ingest_at int")
    a = spark.createDataFrame([("x", "a"), ("y", "b")], "id string, eid string")
    kept, rest = maintain.dedup(m, a)
    assert ids(kept) == ["b", "c"] and ids(rest) == ["y"]
    snap = spark.createDataFrame([("k", "0"), ("l", "0")], "key string, value string")
    log = spark.createDataFrame([(1, "delete", "l", None), (2, "put", "k", "2"), (3, "put", "k", "3"), (4, "delete", "n", None), (5, "?", "k", "9")], "seq int, op string, key string, value string")
    assert sorted(map(tuple, maintain.replay(snap, log, 1).collect())) == [("k", "3"), ("l", "0")]
    with pytest.raises(Exception, match="key exists"):
        maintain.kv_insert(snap, snap).collect()


def test_uid_ranges(spark):
    df = spark.createDataFrame([(1, u) for u in (9, 1, 3, 2, 7, 10, 3)], "k int, uid long")
    assert maintain.uid_ranges(df, "k").first().ranges == "1:3,7,9:10"


def test_uid_ranges_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(maintain, "UID_BLOCK", 4)
    uids = [(k, u) for k in (1, 2) for u in range(60) if (u * 7 + k) % 11 > 2 or 20 < u < 37] + [(None, 3), (1, None)]
    df = spark.createDataFrame(uids + uids[:9], "k int, uid long")

    def ranges(us):
        out = []
        for u in us:
            if out and out[-1][1] == u - 1:
                out[-1][1] = u
            else:
                out.append([u, u])
        return ",".join(str(a) if a == b else f"{a}:{b}" for a, b in out)

    of = {k: sorted(u for j, u in uids if j == k and u is not None) for k in (1, 2)}
    assert {r.k: r.ranges for r in maintain.uid_ranges(df, "k").collect()} == {k: ranges(us) for k, us in of.items()}
    chunks = {(r.k, r.chunk): r.ranges for r in maintain.uid_chunks(df, "k", 7).collect()}
    assert chunks == {(k, c): ranges(us[c * 7 : c * 7 + 7]) for k, us in of.items() for c in range(-(-len(us) // 7))}


def test_deep_paths(spark):
    f = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(70)] + [(100, 101, "x"), (101, 100, "y")], "id int, parent_id int, name string")
    found = {r.id: r.path for r in entities.folder_paths(f).collect()}
    assert all(found[i] == "/".join(f"n{j}" for j in range(i + 1)) for i in range(64)) and found[69].endswith("n68/n69") and set(found) == {*range(70), 100, 101}


def test_account_by_id_or_email(spark):
    a = spark.createDataFrame([(1, "a@x"), (2, "B@x "), (3, "b@x")], "account_id int, email string")
    find = lambda *k: [r.account_id for r in entities.by_id_or_email(a, *k).collect()]
    assert find(3, "a@x") == [3] and find(9, "b@X") == [2] and find(None, "a@x") == [1] and find(9, None) == [] and find(9, "c@x") == []


def test_tree_and_paths(spark):
    f = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "d")], "id int, parent_id int, name string")
    assert {r.id: r.path for r in entities.folder_paths(f).collect()} == {1: "a", 2: "a/b", 3: "a/b/c", 4: "d"}
    assert facets.facet_tree(spark.createDataFrame([(1, ["/a/b", "/a"]), (2, ["/a/c"])], "id int, tags array<string>")).collect()[0].doc_count == 2


def test_stream_keeps_first_copy(spark, tmp_path):
    kind = "account_id int, mailbox_id int, content_hash string, ingest_ts timestamp, id string"
    spark.createDataFrame([(1, 1, "h", None, "x")], kind).withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp")).union(
        spark.createDataFrame([(1, 1, "h", None, "x"), (1, 1, "i", None, "y")], kind).withColumn("ingest_ts", F.lit("2024-01-02").cast("timestamp"))
    ).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    ingest.start(ingest.first_copies(stream), ingest.append_once(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ["x", "y"]


def test_change_stream(spark, tmp_path):
    assert changes.decode_cursor("3:9") == (3, 9) and changes.decode_cursor("x") is None
    assert changes.first_new("3:9", 3) == 10 and changes.first_new("3:9", 4) == 1 and changes.first_new(None, 3) == 1
    box = tmp_path / "box"
    box.mkdir()
    (box / "state.json").write_text(json.dumps({"validity": 7}))
    for uid in (1, 2, 5):
        (box / f"{uid}.eml").write_bytes(b"x%d" % uid)
    reader = changes.ChangesReader(str(box), 2)
    end = reader.latestOffset()
    assert end == {"cursor": "7:5"}
    found = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert [(v, u) for v, u, _ in found] == [(7, 1), (7, 2), (7, 5)]
    assert reader.partitions(end, end) == []


def test_attachment_filter(spark):
    kind = schema.struct(schema.ATTACHMENTS)
    row = {"id": "x", "account_id": 1, "mailbox_id": 1, "name": "Plan.pdf", "subject": "s", "sender": "a@b", "text": "inside words", "size": 5, "date": 1}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in kind.fields)], kind)
    hit = lambda **k: df.where(AttachmentFilter(**k).column()).count()
    assert hit(text="inside") == 1 and hit(attachment_name="Plan.pdf") == 1 and hit(min_page_count=1) == 0 and hit(has_text=True) == 0
