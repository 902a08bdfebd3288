"""The audit of sources and the selection of top rows against plain Python."""

import random
import re
from collections import Counter, defaultdict

from courierlake.llm import source_audit


def by_hand(rows, least_docs, top):
    """The contract in whole numbers, over all terms and all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        groups[lang].add(source)
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least_docs]
        v = len(kept)
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_audit_by_hand(spark):
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma", "été", "日本", "délta", "x", "Zz", "common", "ab", "aba", "abc"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [("en", f"s{r.randrange(6)}", " ".join(r.choice(words[: r.choice([6, 30, 76])]) for _ in range(r.randrange(40)))) for _ in range(200)]
    rows += [("de", "one", "nur eine Quelle " * 3)] * 12 + [(None, None, "common 1common_common")] * 11 + [("fr", "empty", None), ("fr", "other", "?!"), ("en", "s9", None), ("en", None, "x " * 500)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'x' as term", "2 as p", "'v' as value").repartition(3)
    for least, top in ((10, 10), (1, 3)):
        got = sorted(tuple(x) for x in source_audit.audit(docs, least, top).collect())
        assert got == by_hand(rows, least, top)


def test_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    rows = [(x.lang, x.source, x.text) for x in edge_docs.collect()]
    assert sorted(tuple(x) for x in source_audit.audit(edge_docs, 1).collect()) == by_hand(rows, 1, 10)
    assert source_audit.audit(no_docs).count() == 0


def test_top_rows_by_bits_and_bytes(spark):
    """Ties are cut by bytes, over long common beginnings, ends of strings and characters of several bytes; large values take more digits."""
    r = random.Random(9)
    items = ["a" * 300 + x for x in ("", "a", "b", "é", "😀", "￿", "ba", "b\x00", "é1")] + [f"k{i}" for i in range(40)] + ["", "日", "日本", "本"]
    rows = [(g, i, r.choice([0, 5, 5, 5, 300, 300, 1 << 40, (1 << 40) + 1])) for g in range(7) for i in r.sample(items, 9 + 6 * g)]
    held = spark.createDataFrame(rows, "g long, item string, value long").repartition(3)
    for k in (1, 4, 10, 25, 100):
        got = sorted(tuple(x) for x in source_audit.select_top(held, ["g"], "value", "item", k).collect())
        assert got == sorted(x for g in range(7) for x in sorted((y for y in rows if y[0] == g), key=lambda y: (-y[2], y[1].encode()))[:k])
    assert source_audit.select_top(held.where("false"), ["g"], "value", "item").count() == 0
