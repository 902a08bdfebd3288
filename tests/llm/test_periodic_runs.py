"""Runs of words against a search over all periods."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from courierlake.llm import periodic_runs, queries
from courierlake.llm.periodic_runs import Words


def by_hand(w, least_words=24, least_periods=3):
    """For each period the longest stretches that keep it; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(r, n, kinds):
    w = [str(r.randrange(kinds)) for _ in range(n)]
    for _ in range(r.randrange(5)):
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 3))
        e = min(n, a + p * r.randint(2, 9) + r.randint(0, p))
        w[a:e] = [w[a + (i - a) % p] for i in range(a, e)]
    return w + (w[n // 3 :] if r.random() < 0.3 else [])


def test_all_runs_are_found():
    r = random.Random(7)
    for _ in range(250):
        w = planted(r, r.randint(1, 160), r.choice([1, 2, 3, 5, 60]))
        least = r.choice([(24, 3), (24, 3), (6, 3), (4, 2), (24, 2), (2, 2), (5, 4)])
        texts = [Words.of(" ".join(x).encode()) for x in (w, ["a", "b"], [], w[::-1])]
        got = periodic_runs.runs_of_texts(texts, *least)
        assert got == [by_hand(w, *least), [], [], by_hand(w[::-1], *least)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("abc"), max_size=60))
def test_factors_and_blocks(x, y):
    for w in (x, y, x + y + x):
        ids = [ord(c) for c in w]
        order, _ = periodic_runs.suffix_array(periodic_runs.np.array(ids, int))
        order = order.tolist()
        assert order == sorted(range(len(w)), key=lambda i: ids[i:])
        lpf, source = periodic_runs.previous_factors(order, periodic_runs.common_prefixes(ids, order))
        for i in range(len(w)):
            longest = max((next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)), default=0)
            assert lpf[i] == longest and (longest == 0) == (source[i] < 0)
            assert source[i] < i and (longest == 0 or w[source[i] : source[i] + longest] == w[i : i + longest])
        assert by_hand(w, 2, 2) == periodic_runs.runs_of(ids, order, 2, 2)


def expected(doc_id, text):
    """The query's row by plain Python."""
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = by_hand(w)
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    lost = {i for s, e, q in runs for i in range(s + q, e)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in lost)))


def test_query_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and len(short) > 150 and sum(got[r.doc_id][1] > 0 for r in docs) > 5
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    odd = spark.createDataFrame([(1, "a " * 50, "x", 5), (1, "a " * 50, "x", 5), (2, None, None, None), (None, "b c " * 30, "y", 1)], "doc_id long, text string, runs string, collapsed long")
    for docs in (edge_docs, odd):
        planted = periodic_runs.with_planted_runs(docs)
        assert planted.columns == docs.columns and planted.count() == docs.count()
        found = periodic_runs.find_runs(planted)
        assert found.count() == docs.count() and found.columns[-3:] == ["runs", "top_run", "collapsed"]
    rows = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(odd).collect()}
    assert rows == {1: ([(0, 50, 1)], "a"), 2: ([], ""), None: ([(0, 60, 2)], "b c")}
    assert periodic_runs.find_runs(periodic_runs.with_planted_runs(no_docs)).count() == 0
