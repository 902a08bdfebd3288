"""Registered queries against their SQL on small tables with odd rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from courierlake.plans import catalog
from courierlake.sources import mail


def both(spark, at, query, name, table):
    pq.write_table(table, f"{at}/{name}.parquet")
    found = sorted(tuple(r) for r in catalog.queries()[query](spark, str(at)).collect())
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from read_parquet('{at}/{name}.parquet')")
    return found, sorted(con.execute(catalog.oracle_sql()[query]).fetchall())


def test_body_text_of_cut_entities(spark, tmp_path):
    """Headings that are cut off in an entity, unknown entities, and pages without HTML."""
    html = ["<h1>a&amp</h1><p>b &amp; c", "<p>x&&amp", "<p>&lt;b&gt; &copy &copy; &amp;lt; &amplify", "<p>&nosuch; & 1 &#39;", None, ""]
    ids = [3 * i + j for i in range(len(html)) for j in (1, 2, 3)]
    table = pa.table({"page_id": ids, "url": [f"http://x/{i}" if i % 2 else None for i in ids], "html": [html[i // 3] for i in range(len(ids))]})
    found, want = both(spark, tmp_path, "c07_c08_body_text", "pages", table)
    assert str(found) == str(want)


def test_detected_text_of_empty_documents(spark, tmp_path):
    """Null and empty texts, and one of characters that stand for what couldn't be read."""
    table = pa.table({"doc_id": [1, 2, 3, 4], "text": [None, "", "�" * 50 + "ab", "Grüße 漢字"]})
    found, want = both(spark, tmp_path, "s11_detect_text", "documents", table)
    assert found == want


def test_ill_formed_bytes_are_no_text():
    assert not mail.looks_like_text(b"\xff" * 20 + b"abc") and not mail.looks_like_text("é".encode()[:1] * 5) and mail.looks_like_text("�".encode() * 5)
