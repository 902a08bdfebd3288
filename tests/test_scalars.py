"""Scalars that SQL doesn't have, against plain Python over whole tables."""

from html.parser import HTMLParser

import xxhash
from pyspark.sql import functions as F

from courierlake.functions import scalars
from courierlake.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_id_hash(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    found = {r.id: r.hash for r in catalog.queries()["c03_id_hash"](spark, DIR).collect()}
    assert found == {i: xxhash.xxh64_intdigest(t.encode(), seed=42) & (2**53 - 1) for i, t in texts.items()}


class Reader(HTMLParser):
    """The text outside scripts, styles and heads, with entities decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.deep = [], 0

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")
        self.deep += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.out.append(" ")
        self.deep -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.deep:
            self.out.append(data)


def plain(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    return " ".join("".join(reader.out).split())


def test_html_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    found = {r.page_id: r.text for r in catalog.queries()["c08_html_text"](spark, DIR).collect()}
    assert len(found) > 10
    assert found == {i: plain(h) for i, h in pages.items()}


def test_entities(spark):
    rows = ["a &lt;b&gt; &amp;lt; &#8364; &#x20AC; &eacute;&nosuch; &#39;q&#39; &#0; &#99999999;", "<p>x<br>y</p><!-- no --><script>var a = '<p>';</script>&nbsp;z", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", scalars.html_text(F.col("html")).alias("t")).collect()}
    assert got == {0: "a <b> &lt; € € é&nosuch; 'q' &#0; &#99999999;", 1: "x y z", 2: "", 3: None}
