"""The URL models against plain dictionaries, with more distinct contexts than a fixed table has slots."""

import random

import numpy as np

from courierlake.llm import url_markov


def plain(urls):
    contexts, pairs = {}, {}
    for s in (b"\2" * url_markov.ORDER + u.encode() + b"\0" for u in urls):
        for i in range(url_markov.ORDER, len(s)):
            for k in range(url_markov.ORDER + 1):
                c = (k, s[i - k : i])
                contexts[c] = contexts.get(c, 0) + 1
                pairs[c, s[i]] = pairs.get((c, s[i]), 0) + 1
    return contexts, pairs


def loglik(url, contexts, pairs):
    s, out = b"\2" * url_markov.ORDER + url.encode() + b"\0", 0.0
    for i in range(url_markov.ORDER, len(s)):
        q = 1 / 256
        for k in range(url_markov.ORDER + 1):
            c = (k, s[i - k : i])
            q = (pairs.get((c, s[i]), 0) + url_markov.STRENGTH * q) / (contexts.get(c, 0) + url_markov.STRENGTH)
        out += np.log(q)
    return out / (len(s) - url_markov.ORDER)


def random_urls(n, seed=31):
    r = random.Random(seed)
    return ["http://" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(n)]


def test_counts_are_exact_for_many_contexts(spark):
    rows = [(u, i % 2) for i, u in enumerate(random_urls(4000))]
    counts = url_markov.count(spark.createDataFrame(rows, "url string, accepted int").repartition(4))
    test = [u for u, _ in rows[:20]] + ["http://unseen.example/" + "q" * 30, ""]
    good, bad = (plain([u for u, y in rows if y == z]) for z in (1, 0))
    assert counts.where("kind = 1").count() == len(set(good[1]) | set(bad[1])) > 1 << 18
    got = {r.url: r.score for r in url_markov.scored(spark.createDataFrame([(u,) for u in test * 2], "url string"), counts, block=4).collect()}
    assert set(got) == set(test[:-1])
    assert np.allclose([got[u] for u in test[:-1]], [loglik(u, *good) - loglik(u, *bad) for u in test[:-1]], atol=1e-9)


def test_more_urls_do_not_cost_accuracy(spark):
    """Held-out verdicts on URLs whose paths differ by class only in words of their own, among ever more random ones."""
    r, shares = random.Random(32), []
    for n in (2_000, 20_000):
        words = {y: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(40)] for y in (0, 1)}
        noise = random_urls(n, 33)
        rows = [(i, f"http://{'a' if y else 'b'}.net/{'de' if y else 'no'}/{r.choice(words[y])}/{u[-20:]}") for i, u in enumerate(noise) for y in [i % 2]]
        rules = (("allow", "a.net/de/"), ("block", "b.net/no/"))
        asked = [(10**6 + i, f"http://c.org/{r.choice(words[i % 2])}/{u[-20:]}") for i, u in enumerate(random_urls(400, 34))]
        found = url_markov.judge(spark.createDataFrame(rows + asked, "page_id long, url string"), rules).where("page_id >= 1000000").collect()
        shares.append(sum((x.verdict == "allow") == bool(x.page_id % 2) for x in found) / len(found))
    assert len(found) == 400 and shares[1] >= shares[0] - 0.02 and shares[1] >= 0.9, shares


def test_long_urls_and_repeats(spark):
    long = "http://x.net/de/" + "ab" * 40_000
    rows = [(1, long), (2, long), (3, "http://y.info/" + "cd" * 40_000), (4, None)] + [(10 + i, f"http://q{i}.com/en/{i}") for i in range(30)] + [(50 + i, f"http://q{i}.net/de/{i}") for i in range(30)]
    got = {x.page_id: x for x in url_markov.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and got[1].score == got[2].score and got[1].verdict == "allow" and got[4].verdict == "allow"
