"""SimHash, passages, embeddings and mixing against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from courierlake.llm import budget_mix, embedding_lsh, passage_chains, simhash_tree
from courierlake.llm.components import connected_components


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(80)] + [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(7, 7)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    want = groups(1000, links)
    assert got == {i: want[i] for i in {v for a, b in links if a != b for v in (a, b)}}
    assert connected_components(df.where("a < 0")).count() == 0


def test_rounds_of_components_keep_sizes_small(spark):
    """The estimated size of the edges must not grow with the rounds: to its fourth power in each it filled the driver's memory."""
    ids = list(range(400))
    random.Random(4).shuffle(ids)
    found = connected_components(spark.createDataFrame(list(zip(ids[1:], ids[:-1])), "a long, b long"))
    assert sorted((x.node, x.component) for x in found.collect()) == [(i, 0) for i in range(400)]
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 1 << 200


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, edge_docs, no_docs, prose_of):
    r, rows = random.Random(4), []
    for i in range(150):
        words = prose_of(120, i % 60).split()
        if i >= 60:
            words[r.randrange(120)] = f"edit{r.randrange(9)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, prose_of(120, 3)) for i in range(40)] + [(None, prose_of(120, 3)), (6000, None), (6001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_tree.near_duplicates(docs, sample=64, shard=20).collect()
    fps = {t: plain_fingerprint(t or "") for _, t in rows}
    distinct = sorted(set(fps.values()))
    comp = groups(len(distinct), [(a, b) for a in range(len(distinct)) for b in range(a) if (distinct[a] ^ distinct[b]).bit_count() <= 2])
    of, least = dict(zip(distinct, comp)), {}
    for i, t in rows:
        if i is not None:
            c = of[fps[t]]
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), fps[t], least[of[fps[t]]]) for i, t in rows)
    assert sorted((str(x.doc_id), x.fp % 2**64, x.component_id) for x in got) == want
    kept = simhash_tree.keep_one(docs, simhash_tree.near_duplicates(docs))
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted(set(least.values())) and kept.columns == docs.columns
    edge = {(x.doc_id, x.component_id) for x in simhash_tree.near_duplicates(edge_docs).collect()}
    assert {(1, 1), (6, 1), (3, 2), (4, 2), (2, 2), (5, 5), (7, 7), (8, 8)} <= edge
    assert simhash_tree.near_duplicates(no_docs).count() == 0


def test_dense_ball_of_fingerprints():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 1, dtype=np.uint64)
    near = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64)), r.integers(0, 2**63, 1500, dtype=np.uint64)]))
    a, b = simhash_tree.spanning_links(near, 2)
    links = [(i, j) for i in range(len(near)) for j in np.flatnonzero(np.bitwise_count(near[i] ^ near[:i]) <= 2).tolist()]
    assert groups(len(near), zip(a.tolist(), b.tolist())) == groups(len(near), links)
    assert len(a) < 12 * len(near)


def test_chains_by_brute_force():
    r = random.Random(6)
    for _ in range(400):
        n = r.randrange(1, 9)
        pos, ref = np.array(sorted(r.sample(range(60), n))), np.array([r.randrange(60) for _ in range(n)])
        best = 0
        for mask in range(1, 1 << n):
            at = [i for i in range(n) if mask >> i & 1]
            ok = all(ref[b] > ref[a] and pos[b] - pos[a] <= 29 and ref[b] - ref[a] <= 29 for a, b in zip(at, at[1:]))
            if ok:
                best = max(best, 125 + sum(125 - 2 * (pos[b] - pos[a] + ref[b] - ref[a]) for a, b in zip(at, at[1:])))
        c = passage_chains.chain(pos, ref, np.ones(n, int))
        first = c[0]
        got = 125 + sum(125 - 2 * (pos[b] - pos[a] + ref[b] - ref[a]) for a, b in zip(first, first[1:]))
        assert (np.diff(ref[first]) > 0).all() and sorted(i for x in c for i in x) == list(range(n))
        assert got == best


def test_passages(spark, edge_docs, no_docs, prose_of):
    shared, fuzzy = prose_of(80, 99).split(), prose_of(90, 98).split()
    rows = [(i, prose_of(120, i)) for i in range(30)]
    for i in (3, 11, 25):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:40] + shared + w[40:]))
    for i in (5, 17):
        w, f = rows[i][1].split(), list(fuzzy)
        if i == 17:
            for at in range(8, 90, 13):
                f[at] = "edited"
        rows[i] = (i, "\n".join([" ".join(w[:30]), " ".join(f), " ".join(w[30:])]))
    rows += [(40, rows[7][1]), (41, "go " * 300), (42, "go " * 200), (43, None), (44, ""), (None, rows[7][1])]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, passages string").repartition(4)
    found = passage_chains.repeated_passages(docs)
    got = {r.doc_id: [tuple(p) for p in r.passages] for r in found.collect()}
    assert set(got) == {11, 25, 17, 40, 42}
    assert got[11] == [(40, 120, 3)] and got[25] == [(40, 120, 3)] and got[40] == [(0, 120, 7)] and got[42] == [(0, 200, 41)]
    (s, e, ref), = got[17]
    assert ref == 5 and s in range(28, 39) and e in range(108, 122)
    cut = {r.doc_id: r for r in passage_chains.cut_passages(docs, found).collect()}
    assert len(cut[11].text.split()) == 120 and cut[11].n_chars == len(cut[11].text) and cut[3].text == rows[3][1] and cut[40].text.strip() == ""
    assert passage_chains.cut_passages(docs, found).columns == docs.columns and passage_chains.cut_passages(docs, found).count() == len(rows)
    assert passage_chains.repeated_passages(edge_docs).count() == 0 and passage_chains.repeated_passages(no_docs).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + 0.15 * r.normal(size=(30, 16)), np.repeat(base[:1], 25, axis=0), base[5:6] * 3.5])
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] + [1.0] * 15), (5, [None] + [1.0] * 15), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, base[3].tolist()), (8, [float("inf")] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_lsh.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    fine = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a in range(len(fine)) for b in range(a) if len(fine[a][1]) == len(fine[b][1]) and fine[a][1] @ fine[b][1] / np.linalg.norm(fine[a][1]) / np.linalg.norm(fine[b][1]) >= 0.9]
    deg = defaultdict(int)
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    comp, least = groups(len(fine), links), {}
    for k, (i, _) in enumerate(fine):
        if i is not None:
            least[comp[k]] = min(least.get(comp[k], i), i)
    for k, (i, _) in enumerate(fine):
        assert got[i] == (deg[k], least[comp[k]]), i
    assert all(got[i] == (0, i) for i in (1, 2, 3, 4, 5, 8))
    assert embedding_lsh.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall_on_whole_rows(spark):
    """Links on whole rows and copies of them at cosines near 0.9 against brute force in double precision; clashing names and rows that share an id."""
    held = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    r, x = np.random.default_rng(14), np.array([v for _, v in held], float)
    noise = r.normal(size=x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(x.shape[1])
    held += [(10**6 + i, (v + 0.45 * n).tolist()) for (i, _), v, n in zip(held, x, noise)]
    rows = spark.createDataFrame(held, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("c"), F.lit("x").alias("key"))
    held = [(r.vec_id, r.embedding) for r in rows.collect()]
    x = np.array([v for _, v in held], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    got = {r.vec_id: r for r in embedding_lsh.near_duplicates(rows).collect()}
    links, found = near.sum() - len(x), sum(r.n_links for r in got.values())
    assert links > 400 and 0.95 * links <= found <= links
    assert all(got[i].n_links <= near[k].sum() - 1 for k, (i, _) in enumerate(held))
    twice = embedding_lsh.near_duplicates(rows.where("vec_id < 40").union(rows.where("vec_id < 40")))
    assert twice.count() == 2 * rows.where("vec_id < 40").count() and twice.where("n_links < 1").count() == 0


def test_embedding_recall():
    r = np.random.default_rng(8)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(400, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (1_000, 50_000):
        hashes, tables = embedding_lsh.settings(n, 64)
        h = embedding_lsh.CrossPolytope(64, hashes, tables)
        assert embedding_lsh.met_before(h.buckets(a), h.buckets(b), tables).mean() >= 0.95
    x = r.normal(size=(5, 8))
    full = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(embedding_lsh.hadamard(x), x @ full)


def test_knapsack_by_brute_force():
    r = random.Random(9)
    for _ in range(150):
        n = r.randrange(1, 7)
        lengths, counts, budget = np.array(r.sample(range(50), n)), np.array([r.randrange(1, 5) for _ in range(n)]), r.randrange(150)
        sums = {0}
        for length, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + length * j for s in sums for j in range(c + 1)}
        taken = budget_mix.knapsack(lengths, counts, budget)
        assert (lengths * taken).sum() == max(s for s in sums if s <= budget) and (taken <= counts).all()


def test_budget_is_filled_by_the_knapsack():
    r = np.random.default_rng(12)
    lengths = np.sort(r.choice(np.arange(1, 60_000), 5_000, replace=False))
    counts = r.integers(1, 50, 5_000)
    total = int((lengths * counts).sum())
    for budget in (1, 77, 5_000, total // 3, total // 2 + 1, total - 20_000):
        taken = budget_mix.fit_budget(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and abs((lengths * taken).sum() - budget) <= (1 if budget > 10_000 else 20)  # of few words not every number is a sum of lengths
    shares = budget_mix.fit_budget(lengths, counts, total // 2)[counts > 20] / counts[counts > 20]
    assert abs(shares - 0.5).max() < 0.15  # long documents aren't preferred


def test_mix(spark, edge_docs, no_docs):
    r = random.Random(10)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)] + [(i, "same text here", "a") for i in range(600, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((x.doc_id, x["size"], x.source_size, x.target, x.copies) for x in budget_mix.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == 900
    source, sizes, taken, target = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int), {}
    for i, n, whole, aim, copies in first:
        assert n == len(rows[i][1].split()) and 0 <= copies <= 2
        sizes[source[i]] += n
        taken[source[i]] += n * copies
        target[source[i]] = aim
    assert target == budget_mix.targets(sizes) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    mixed = budget_mix.mixed(docs)
    assert mixed.columns == docs.columns and sum(len(x.text.split()) for x in mixed.collect()) == sum(taken.values())
    assert budget_mix.mix(edge_docs).count() == 11 and budget_mix.mix(no_docs).count() == 0
    assert budget_mix.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
