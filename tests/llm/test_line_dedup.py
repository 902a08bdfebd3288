"""Lines that documents share, against plain Python."""

import random
from collections import defaultdict

from courierlake.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least_chars=10, least_docs=2):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held[key(line)].add(i)
    shared = {k: min(ids) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or shared.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_lines(df, **kw).collect()), key=repr)


def test_lines_by_hand(spark):
    r = random.Random(2)
    pool = ["Subscribe to our newsletter", "  SUBSCRIBE to our newsletter\t", "short", "ÄÖÜ ÄÖÜ ÄÖ", "äöü äöü äö", "日本語日本語日本語日", "日本語日本語日本", "", " \x0b\x0c ", "x" * 5000, "exactly10!", "only nine", " padded line ", "padded line"]
    rows = [(r.choice([i, i, i, i // 2, None]), r.choice([None, "", "\n", "\n\n"]) if r.random() < 0.2 else "\n".join(r.choice(pool + [f"line {r.randrange(60)} of its own"]) for _ in range(r.randrange(12)))) for i in range(120)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as h", "1 as first", "2 as n", "'y' as hashes", "9 as n_lines").repartition(4)
    for least_chars, least_docs in ((10, 2), (1, 2), (10, 4)):
        assert found(docs, least_chars=least_chars, least_docs=least_docs) == by_hand(rows, least_chars, least_docs)


def test_a_line_that_most_documents_hold(spark):
    rows = [(i, "a banner that all pages carry\n" + f"own line number {i}\na banner that all pages carry") for i in range(500)]
    got = {i: (n, text) for i, _, n, text in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[0] == (0, rows[0][1]) and all(got[i] == (2, f"own line number {i}") for i in range(1, 500))


def test_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in edge_docs.collect()]
    assert found(edge_docs) == by_hand(rows)
    out = line_dedup.drop_lines(edge_docs)
    assert out.columns == [*edge_docs.columns, "n_lines", "n_dropped"]
    assert all(r.n_chars == len(r.text) for r in out.where("n_dropped > 0").collect())
    assert line_dedup.drop_lines(no_docs).count() == 0
