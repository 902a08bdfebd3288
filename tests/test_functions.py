"""Tokens, grams, query syntax, scalars and MIME parsing on small cases."""

import base64
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courierlake.functions import mime, scalars, text
from courierlake.operators import maintain
from courierlake.sources import mail


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("s")), s="对讲机") == ["对", "讲", "机"]
    assert one(spark, text.tokens(F.col("s")), s="Étoiles, ÆON!") == ["etoiles", "aeon"]
    assert one(spark, text.tokens(F.col("s")), s="a" * 41) == []
    grams = [tuple(g) for g in one(spark, text.cjk_grams(F.col("s")), s="对讲机")]
    assert grams == [(0, "对"), (0, "对讲"), (1, "讲"), (1, "讲机"), (2, "机")]


def test_grams(spark):
    assert one(spark, text.grams(F.col("s")), s="Kroatiens") == ["kro", "roa", "oat", "ati", "tie", "ien", "ens"] == text.query_grams("Kroatiens")
    assert text.query_grams("Été") == ["ete"]
    assert text.query_grams("ab") == text.query_grams("对讲机") == []


def match(spark, doc, query):
    return one(spark, text.fuzzy_match([text.gram_text(F.col("s"))], query), s=doc)


def test_fuzzy(spark):
    assert match(spark, "Haus am See", "haus") and match(spark, "Mauser Gewehr", "aus") and not match(spark, "Mauser Gewehr", "haus")
    assert match(spark, "Laserdrucker", "laserdruckers") and not match(spark, "Laserpointer", "laserdruckers")
    assert not match(spark, "alert OR x", "alert OR")


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=3, max_size=7), st.text("abc", max_size=12))
def test_missing_gram_rule_is_leave_one_out(term, doc):
    q, d = text.query_grams(term), set(text.query_grams(doc))
    brute = set(q) <= d or (len(q) >= 3 and any(set(q[:i] + q[i + 1 :]) <= d for i in range(len(q))))
    missing = set(q) - d
    assert brute == (not missing or (len(q) >= 3 and len(missing) == 1 and q.count(next(iter(missing))) == 1))


def test_query_syntax(spark):
    hit = lambda doc, q: one(spark, text.word_match([text.sequence_text(F.col("s"))], q), s=doc)
    a, b = "the quick brown fox", "the lazy brown dog"
    assert hit(a, "quick fox") and not hit(b, "quick fox")
    assert hit(a, "fox OR dog") and hit(b, "fox OR dog")
    assert hit(a, '"quick brown"') and not hit(b, '"quick brown"')
    assert hit(b, "brown -fox") and not hit(a, "brown -fox") and not hit(a, "-dog") and not hit(a, "")
    assert hit("型号对讲机好", "对讲机") and not hit("讲对机", "对讲机")
    assert hit("mail to a.b@example.com now", "a.b@example.com")


def test_scalars(spark):
    ext = lambda s: one(spark, scalars.extension(F.col("s")), s=s)
    assert (ext("a/b.TAR.GZ"), ext(".bashrc"), ext("x"), ext("x.")) == ("gz", None, None, "")
    cat = lambda n, t: one(spark, scalars.category(F.col("n"), F.col("t")), n=n, t=t)
    assert cat("x.unknown", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet") == "document"
    assert cat("x", "application/x-zip-compressed") == "archive" and cat("a.RS", "") == "code" and cat("x", "application/q") == "other"
    date = lambda a, b: one(spark, scalars.effective_date(F.col("a"), F.col("b")), a=a, b=b)
    assert (date(5, 3), date(0, 3), date(5, 0), date(0, 0)) == (3, 3, 5, None)


def test_schema_version(spark):
    from courierlake import schema

    df = schema.stamped(spark.createDataFrame([], schema.struct(schema.MESSAGES)))
    assert schema.checked(df).columns == df.columns
    with pytest.raises(ValueError):
        schema.checked(schema.stamped(df, 3))


EML = b"""From: Ann <Ann@Example.com>\r\nTo: b@example.com, C <c@example.com>\r\nSubject: =?utf-8?q?Gr=C3=BC?= =?utf-8?q?=C3=9Fe?=\r\nDate: Mon, 01 Jan 2024 00:00:00 +0000\r\nMessage-ID: <m1@x>\r\nReferences: <r0@x> <r1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello\r\n--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--B--\r\n"""


def test_parse_message(spark, tmp_path):
    m = mime.parsed(EML)
    assert (m["sender"], m["to"], m["subject"], m["date_ms"], m["references"], m["body"].strip()) == ("ann@example.com", ["b@example.com", "c@example.com"], "Grüße", 1704067200000, ["r0@x", "r1@x"], "hello")
    assert [(a["filename"], a["size"]) for a in m["attachments"]] == [("a.pdf", 3)]
    (tmp_path / "1.eml").write_bytes(EML)
    row = mail.read_eml(spark, str(tmp_path)).first()
    assert row.message.subject == "Grüße" and row.message.error is None


def test_mbox(spark, tmp_path):
    line = b"From a@x Mon Jan  1 00:00:00 2024\n"
    (tmp_path / "a.mbox").write_bytes(b"junk\n" + line + b"one\n>From x\n" + line + b"two")
    found = sorted((r["at"], bytes(r["raw"])) for r in mail.read_mbox(spark, str(tmp_path)).collect())
    assert found == [(5, b"one\n>From x\n"), (5 + len(line) + 12, b"two")]
    fmt = lambda b, n: spark.createDataFrame([(b, n)], "c binary, n string").select(mail.detect_format(F.col("c"), F.col("n"))).first()[0]
    assert fmt(line, "x") == "mbox" and fmt(b"From: a", "x.mbox") == "eml" and fmt(b"?", "a.PST") == "pst" and fmt(b"?", "a") is None
    assert mail.looks_like_text("Grüße".encode()) and not mail.looks_like_text(b"a\0b") and not mail.looks_like_text(b"") and not mail.looks_like_text(b"\x01" * 5)


def test_long_metadata_is_one_header(spark):
    df = spark.createDataFrame([("a@x", 0, "raw", "m" * 200)], "sender string, date long, raw string, meta string")
    lines = df.select(mail.mbox_text(meta="meta")).first()[0].split("\n")
    assert len(lines) == 4 and base64.b64decode(lines[1].removeprefix("X-Archive-Metadata: ")) == b"m" * 200 and lines[2] == "raw"


def test_mbox_in_ranges(spark, tmp_path):
    """Ranges that cut lines, separators and messages anywhere give each message once."""
    bodies = [b"x" * (i * 7 % 50) + b"\r\nFrom: not a separator\n" * (i % 3) for i in range(40)]
    data, at = b"", []
    for i, b in enumerate(bodies):
        at.append(len(data))
        data += b"From a@x Mon Jan  1 00:00:00 2024\n" + b + b"\n"
    (tmp_path / "a.mbox").write_bytes(data)
    (tmp_path / "empty.mbox").write_bytes(b"")
    reader = lambda n: mail.MboxReader(str(tmp_path), n)
    for n in (1, 2, 3, 17, 35, 64, 1000, 10**6):
        found = [(a, r) for p in reader(n).partitions() for _, a, r in reader(n).read(p)]
        assert found == [(a, b + b"\n") for a, b in zip(at, bodies)], n
    df = mail.read_mbox(spark, str(tmp_path), 100)
    assert df.rdd.getNumPartitions() > 10 and sorted(r["at"] for r in df.collect()) == at


def test_first_recipient(spark):
    kind = "id int, message struct<to:array<string>>"
    m = spark.createDataFrame([(1, (["A@x", "b@x"],)), (2, (["c@x", "a@x"],)), (3, ([],)), (4, (None,)), (5, None)], kind)
    found = mail.for_first_recipient(m, spark.createDataFrame([(7, "a@x"), (8, " a@X"), (9, "b@x")], "account_id int, email string")).collect()
    assert [(r.id, r.account_id, r.mailbox_id) for r in found] == [(1, 7, "INBOX")]


def test_detached_columns(spark):
    mixed = b"From: a@x\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nQUJD\r\n--b\r\nContent-Type: application/pdf; name=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\nREVG\r\n--b\r\nContent-Type: image/png\r\n\r\n\xff\xfe\r\n--b--\r\n"
    rows = [(1, mixed), (2, b"Subject: x\n\nplain"), (3, b""), (4, mixed), (5, None)]
    df = spark.createDataFrame(rows, "id int, raw binary").select("id", mime.detached(F.col("raw")).alias("d"))
    got = {r.id: r.d for r in df.collect()}
    assert [bytes(p.body) for p in got[1].parts] == [b"QUJD\r\nREVG", b"\xff\xfe"] and got[1].raw.count(b"[detached:") == 2 and b"text/plain\r\n\r\nQUJD\r\n" in got[1].raw
    assert bytes(got[2].raw) == rows[1][1] and not got[2].parts and not got[3].parts
    bodies = df.select(F.explode("d.parts").alias("p")).select("p.*")
    back = maintain.reattach_parts(df.select("id", "d.raw"), bodies)
    assert {r.id: bytes(r.raw) for r in back.collect()} == {i: b or b"" for i, b in rows}
    none = maintain.reattach_parts(df.select("id", "d.raw"), bodies.limit(0)).collect()
    assert {r.id: bytes(r.raw) for r in none} == {i: bytes(d.raw) for i, d in got.items()}


def test_detached_parts():
    body = {"0" * 64: b"AB", "1" * 64: b"CD"}
    raw = b"xxAByyCDzz"
    stripped = mime.strip_parts(raw, [(2, 4, "0" * 64), (6, 8, "1" * 64)])
    assert mime.reattach(stripped, body) == raw and stripped != raw


def test_office_text():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w><p>Hello</p><p>world</p></w>")
    assert mime.office_text("docx", held.getvalue()) == "Hello world"
    assert mime.office_text("docx", b"damaged") is None and mime.office_text("exe", b"x") is None
