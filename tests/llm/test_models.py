"""Toxicity, quality and URL models: planted cases, held-out accuracy, edge rows."""

import random
import zlib

import numpy as np

from courierlake.llm import quality_qda, toxicity_fm, url_markov


def labelled(spark, n=900):
    """A text is toxic only if an insult and a group meet in it."""
    r, rows = random.Random(3), []
    for i in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 40))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["blockhead"] * insult + ["islanders"] * group
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_pairs_are_learnt(spark):
    rows, docs, labels = labelled(spark)
    model = toxicity_fm.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity_fm.score(docs, model).collect()}
    held = [(y, scores[i] >= 0.7) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([y == p for y, p in held]) > 0.97


def test_terms_that_matter_only_together(spark):
    """An insult and a group, each balanced over the labels: toxic where both or neither is there."""
    r, rows = random.Random(7), []
    for i in range(1500):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 40))] + ["blockhead"] * insult + ["islanders"] * group
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult == group)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity_fm.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    scores = {s.doc_id: s.score for s in toxicity_fm.score(docs, model).collect()}
    assert np.mean([y == (scores[i] >= 0.5) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.95


def test_pair_gains_by_double_loop():
    r = np.random.default_rng(2)
    rows, labels = [np.flatnonzero(r.random(12) < 0.5) for _ in range(3000)], r.integers(0, 2, 3000).astype(float)
    gains = toxicity_fm.pair_gains(rows, labels, 12)

    def gain(a, b):
        n = np.zeros((2, 2))
        for row, y in zip(rows, labels):
            if a in row:
                n[int(b in row), int(y)] += 1
        e = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
        return 2 * (n * np.log(n / e)).sum()

    assert all(abs(gains[a, b] - min(gain(a, b), gain(b, a))) < 1e-2 for a in range(12) for b in range(a))


def test_score_by_double_loop():
    r = np.random.default_rng(4)
    m = toxicity_fm.FactorizationMachine({}, 0.3, r.normal(size=30), r.normal(size=(30, 8)))
    for _ in range(50):
        terms = sorted(map(int, r.choice(30, r.integers(0, 12), replace=False)))
        z = 0.3 + sum(m.weights[t] for t in terms) + sum(m.factors[a] @ m.factors[b] for a in terms for b in terms if a < b)
        assert abs(m.score(terms) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_edges(spark, edge_docs, no_docs):
    _, docs, labels = labelled(spark, 300)
    model = toxicity_fm.fit(docs, labels.union(spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")))
    found = toxicity_fm.score(edge_docs, model).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert toxicity_fm.score(no_docs, model).count() == 0
    kept = toxicity_fm.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == 11
    unfitted = toxicity_fm.fit(no_docs, labels)
    assert {r.score for r in toxicity_fm.score(edge_docs, unfitted).collect()} == {0.5}
    one_class = toxicity_fm.fit(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity_fm.score(docs, one_class).collect()) < 0.1


def test_discriminant_matches_densities():
    r = np.random.default_rng(0)
    d = quality_qda.WIDTH
    x = [r.normal(size=(500, d)), r.normal(size=(400, d)) * 2 + 1]
    m = quality_qda.discriminant(np.array([500.0, 400.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    test = r.normal(size=(20, d))
    logs = []
    for y in (0, 1):
        cov = np.linalg.inv(m.factors[y].T @ m.factors[y])
        diff = test - m.means[y]
        logs.append(np.log((len(x[y]) + 0.5) / 901) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(m.scores(test), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40))))
    assert (m.scores(x[1]) > 0.5).mean() > 0.95 and (m.scores(x[0]) < 0.5).mean() > 0.95


def test_quality(spark, edge_docs, no_docs, prose_of):
    rows = [(i, prose_of(60, i) if i % 3 else "!! " * 50 + "BUY NOW " * (i % 7 + 1), int(i % 3 > 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_qda.classify(docs, labels).collect()}
    assert all((scores[i] >= 0.5) == bool(y) for i, _, y in rows)
    found = quality_qda.classify(edge_docs, labels).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert quality_qda.classify(no_docs, labels).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, score double, html string")


def test_url_rules_and_models(spark):
    rows = [(0, "http://A.B.Example.COM/en/7x?q", None, ""), (1, "x://example.com/en/8", 1.0, ""), (2, None, None, None), (3, "no scheme/en/", 1.0, ""), (4, "", 1.0, ""), (5, "http://notcom/en/", 1.0, ""), (6, "http://q.example.net/de/80#f", 1.0, ""), (6, "http://q.example.net/de/80#f", 1.0, ""), (7, "http://q.net?x/de/", 1.0, ""), (8, "h://Z.ORG/es/ a\nb", 1.0, "")]
    rows += [(100 + i, f"http://good{i}.net/de/{i}", None, "") for i in range(40)] + [(200 + i, f"http://bad{i}.com/en/{i}", None, "") for i in range(40)]
    rows += [(300, "http://good7.info/de/5", None, ""), (301, "http://bad9.info/en/5", None, "")]
    found = {r.page_id: r for r in url_markov.judge(pages(spark, rows)).collect()}
    assert (found[0].host, found[0].path, found[0].rule, found[0].verdict) == ("a.b.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (found[1].rule, found[1].verdict) == ("com/en/", "block")
    assert [(found[i].host, found[i].path, found[i].rule) for i in (2, 3, 4)] == [("", "", None)] * 3 and found[2].verdict == "allow"
    assert found[5].rule is None and (found[6].rule, found[6].verdict) == ("example.net/de/8", "block")
    assert (found[7].host, found[7].path, found[7].rule) == ("q.net", "", None) and found[8].rule == "org/es/"
    assert found[300].verdict == "allow" and found[301].verdict == "block"
    assert url_markov.judge(pages(spark, rows)).count() == len(rows) and url_markov.judge(pages(spark, [])).count() == 0
    alone = url_markov.judge(pages(spark, [(1, "http://q.info/", None, "")])).collect()
    assert alone[0].verdict == "allow"


def test_pairs_have_room_beside_many_tied_terms(spark):
    """Half the rows are toxic just where two words are both there or both absent; thousands of other words tell about the other half."""
    import random

    from pyspark.sql import functions as F

    from courierlake.llm import shared, toxicity_fm

    r, rows = random.Random(3), []
    for i in range(6000):
        words = [f"noise{r.randrange(400)}" for _ in range(12)]
        if i % 2:
            a, b = r.random() < 0.5, r.random() < 0.5
            y, words = int(a == b), words + ["insultword"] * a + ["groupword"] * b
        else:
            y = r.randrange(2)
            words += [f"{'tox' if y else 'fine'}{r.randrange(1500)}" for _ in range(40)]
        r.shuffle(words)
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity_fm.fit(docs, docs.select("doc_id", F.col("y").alias("toxic")))
    held = toxicity_fm.score(docs, model).join(docs, "doc_id").where(shared.held_out()).where("doc_id % 2 = 1")
    assert len(model.column) > 2_048 and held.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0] >= 0.95
