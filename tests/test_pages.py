"""Readable text of pages."""

from pyspark.sql import functions as F

from courierlake.functions import pages

GOLDEN = {
    "<html><body><p>Hello World</p></body></html>": "Hello World",
    "<div><h1>Title</h1><p>Paragraph with <b>bold</b> text.</p></div>": "# Title\n\nParagraph with bold text.",
    "": "",
    "Just some plain text without any HTML tags.": "Just some plain text without any HTML tags.",
    '<a href="https://example.com">Click here</a>': "Click here",
    "<p>a<br>b</p><p>c": "a\nb\n\nc",
    "<ul><li>one<li>two <ul><li>deep</ul></li></ul><ol start=3><li>x</li><li>y</li></ol>": "* one\n* two\n  * deep\n\n3. x\n4. y",
    "<blockquote><p>said</p><p>again</p></blockquote>after": "> said\n\n> again\n\nafter",
    "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>": "A | B\n1 | 2",
    "<head><title>t</title><style>p{}</style></head><script>var t='</p>';</script>x<!-- no -->y": "xy",
    "a &amp; b &lt;c&gt; &#233; &nosuch; 1 < 2": "a & b <c> é &nosuch; 1 < 2",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "<p>unclosed <div>inside</span></div>": "unclosed\ninside",
    "<img src=x alt='A picture'> and <hr>": "A picture and\n\n" + "-" * 100,
}


def test_golden_pages(spark):
    rows = spark.createDataFrame(list(GOLDEN.items()), "html string, want string").select("html", "want", pages.readable(F.col("html")).alias("got")).collect()
    for r in rows:
        assert r.got.strip("\n") == r.want, r.html


def test_lines_have_a_width():
    lines = pages.laid_out("<ul><li>" + "word " * 100 + "</li></ul><p>" + "x" * 150 + " y").split("\n")
    assert all(len(x) <= 100 for x in lines if "x" not in x) and lines[0].startswith("* word") and lines[1].startswith("  word") and "x" * 150 in lines
    assert pages.laid_out("<p>" * 3000 + "deep") == "deep" and pages.laid_out("<ul><li>" * 200 + "deep").endswith("* deep")


def test_text_or_else_the_page(spark):
    rows = [(" a\n b ", "<p>c"), (None, "<p>c</p><p>d"), ("", "<p>c"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, h string").select(pages.body_text(F.col("t"), F.col("h"))).collect()]
    assert got == ["a b", "c d", "", ""]
