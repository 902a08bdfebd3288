"""The pipeline's near-copy stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import pyarrow as pa
from courierlake.llm import simhash_tree


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Clean texts, copies of some at five-word similarities from 0.7 to 1, and a group of many near copies."""
    r = random.Random(21)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base = [text(r.choice([60, 100, 200, 300])) for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:80]):
        w = list(w)
        for at in r.sample(range(len(w)), max(1, len(w) * (i % 4 + 1) // 200)):
            w[at] = "edited"
        rows.append((1000 + i, " ".join(w)))
    for i in range(60):
        w = list(base[100])
        w[r.randrange(len(w))] = f"x{i}"
        rows.append((2000 + i, " ".join(w)))
    return rows + [(3000, rows[5][1].upper()), (3001, "a b"), (3002, "A b"), (3003, ""), (3004, None), (None, rows[5][1])]


def plain(rows):
    sets, up = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows) if d is not None}


def test_stage_removes_near_copies(spark):
    rows = planted()
    docs, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), plain(rows)
    kept = [r.doc_id for r in corpus_pipeline.simhash(spark, docs, "").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values())) and kept.count(None) == 1
    assert len(set(want.values())) < 160


def test_blocks_and_verification(spark):
    rows = planted()
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), plain(rows)
    for kw in ({"block": 16}, {"radius": 1024}):  # all pairs are candidates, only true copies are linked
        got = {r.doc_id: r.component_id for r in simhash_tree.near_copies(docs, **kw).collect() if r.doc_id is not None}
        assert got == want
    assert simhash_tree.near_copies(docs.where("false")).count() == 0


def test_rows_that_share_an_id(spark):
    a, b, c = ("one two three four five six seven", "quite another text of eight words in all", "and a third one that nothing else is like")
    docs = spark.createDataFrame([(1, a, 0), (1, a, 0), (1, b, 0), (2, b, 0), (1, c, 0), (3, None, 0), (3, "", 0), (None, a, 0)], "doc_id long, text string, group_id int")
    for found in (simhash_tree.near_copies(docs), simhash_tree.near_duplicates(docs)):
        kept = simhash_tree.keep_one(docs, found)
        rows = sorted((r.doc_id, r.text or "") for r in kept.where("doc_id is not null").collect())
        assert rows == sorted([(1, a), (1, b), (1, c), (3, "")]) and kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_pairs_without_a_band(spark):
    """Pairs just at the similarity of which no band is the same: one in some 4,500."""
    r = random.Random(5)
    rows = []
    while len(rows) < 4:
        texts = []
        for _ in range(500):
            w = [f"w{r.randrange(10**6)}" for _ in range(19)]
            texts += [" ".join(w[:16]), " ".join(w)]
        bands = simhash_tree.band_keys(simhash_tree.shingle_sets(pa.array(texts), 5))
        for i in range(0, len(texts), 2):
            if not (bands[i] == bands[i + 1]).any():
                rows += [(len(rows), texts[i]), (len(rows) + 1, texts[i + 1])]
    want = plain(rows)
    assert want == {i: i - i % 2 for i in range(len(rows))}
    for kw in ({}, {"radius": 1024}):
        assert {r.doc_id: r.component_id for r in simhash_tree.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()} == want


def test_no_link_depends_on_fingerprints(spark):
    """Where fingerprints find equal ones alone, the exact pass finds all others, also in blocks."""
    rows = planted()
    want = plain(rows)
    found = simhash_tree.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=0, block=16)
    assert {r.doc_id: r.component_id for r in found.collect() if r.doc_id is not None} == want
