"""Stored terms, the query grammar, grams by contains, and letters of other scripts."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courierlake.functions import text as X
from courierlake.operators import search, terms
from courierlake.operators.filters import MessageFilter, words_or_grams

WORDS = "green ferry mill Harbour account ready Größe straße œuvre Ωμέγα день объект été timetable of the Winter".split()


def mails(spark, n=60, seed=1):
    r = random.Random(seed)
    pick = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randrange(k)))
    rows = [(i, i % 3, 1, pick(5), pick(30), f"{r.choice(WORDS)}@alpha.test", [f"bob{i % 5}@beta.test", "Two Words"], None if i % 4 else ["carol@gamma.test"], [], [f"file{i % 7}.pdf"], 1000 * i, 0, 0, i, 1, None) for i in range(n)]
    rows += [(n, 0, 1, None, None, None, None, None, None, None, None, None, None, None, None, None), (n + 1, 1, 1, "", "the the of the", "", [], [], [], [], 5, 5, 5, 5, 0, [])]
    return spark.createDataFrame(rows, "id long, account_id long, mailbox_id long, subject string, body string, sender string, to array<string>, cc array<string>, bcc array<string>, attachment_name array<string>, date long, internal_date long, ingest_at long, size long, regular_attachment_count long, tags array<string>").cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_stored_terms_find_what_texts_hold(spark, tmp_path):
    df = mails(spark)
    terms.write(terms.term_rows(df.where("id < 40")), str(tmp_path), "overwrite")
    terms.write(terms.term_rows(df.where("id >= 40")), str(tmp_path))  # a later ingest
    index = terms.TermIndex(spark, str(tmp_path))
    for q in ("green", "green mill", "mill OR green", '"green mill"', "green -mill", "-mill", "", "Grosse", "straße", "den'", "omega", "al*", '"of th*"', "a*", "subject:mill", "-subject:mill green", "unknown:mill", '"the of the"', "Harbour^3 account"):
        assert ids(index.matches(q, ["subject", "body"])) == ids(df.where(words_or_grams(q, ["subject", "body"]))), q
    for what in (MessageFilter(text="Harbou"), MessageFilter(subject="timetab"), MessageFilter(sender="mill@alpha.test"), MessageFilter(any_recipient="carol"), MessageFilter(any_participant="gamm"), MessageFilter(to='"bob1 beta"', since=9000), MessageFilter(to='"test two"'), MessageFilter(body="the", text="size:[3 TO 30] of"), MessageFilter(cc="gamm", text="mill")):
        want = df.where(what.column({0, 1}))
        assert ids(index.hits(df, what, {0, 1})) == ids(want), what
        scored = lambda x: [(r.id, round(r.score, 6)) for r in x.collect()]
        if what.has_text() and "[" not in (what.text or ""):
            page = {"accounts": {0, 1}, "sort_by": "RELEVANCE", "size": 500}
            assert scored(search.search(df, what, index=index, **page)) == scored(search.search(df, what, **page)), what
    plain, stored = (search.bm25(df, "green mill^2", {"body": 1.0, "subject": 2.0}, index=i).select("id", F.round("score", 6).alias("s")) for i in (None, index))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, stored.collect()))
    plan = index.matches("green mill", ["body"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(term" in plan


def test_space_separated_terms_are_anded(spark):
    df = spark.createDataFrame([("both", "green ferry of the harbour"), ("one", "green only")], "id string, body string")
    word = lambda q: ids(df.where(words_or_grams(q, ["body"])))
    assert word("green") == ["both", "one"] and word("green harbour") == ["both"] and word("harbour OR green") == ["both", "one"]
    assert word('"ferry of"') == ["both"] and word("green -harbour") == ["one"] and word("harb*") == ["both"] and word("body:only") == ["one"]


def test_the_best_match_comes_first(spark):
    rows = [("best", "Harbour timetable", "The harbour timetable has changed."), ("passing", "Notes of a walk", "Past fields, a mill, two villages and a long wall the path comes down to a harbour, and from there along the shore, by boat sheds and gardens, back home.")]
    df = spark.createDataFrame(rows, "id string, subject string, body string")
    assert [r.id for r in search.by_relevance(df, "harbour", {"subject": 3.0, "body": 1.0}, 1, 10).collect()] == ["best", "passing"]


@settings(max_examples=200, deadline=None)
@given(st.text("abßæœþsшщжΘφx é", max_size=12), st.text("abßæœþsшщжΘφx", min_size=3, max_size=5))
def test_grams_by_contains_are_the_windows(text, term):
    """A gram is among the folded windows of a text just if the text contains one of its spellings."""
    s = text.lower().translate(str.maketrans(X.FROM, X.TO))
    windows = {"".join(X.SEVERAL.get(c, c) for c in s[i : i + 3]) for i in range(len(s) - 2)}
    for g in X.query_grams(term):
        assert (g in windows) == any(w in s for w in X.gram_spellings(g))


def test_windows_and_contains_agree_in_spark(spark):
    df = spark.createDataFrame([(s,) for s in ("Straße", "strasse", "ΘΦΧ φως", "Жук щука", "aßb", None, "", "ab", "assb")], "t string")
    for term in ("straße", "strasse", "щука", "φως", "aßb", "assb", "Жук"):
        has = X.enough_grams(term, lambda g: F.array_contains(X.grams(F.col("t")), g))
        rows = df.select(has.alias("a"), X.grams_match(X.gram_text(F.col("t")), term).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.b for r in rows), term


def test_greek_and_cyrillic_fold_to_latin(spark):
    pairs = {"Αθήνα": "athena", "ΨΥΧΉ": "psukhe", "Ξένος": "xenos", "Москва": "moskva", "Щука": "shchuka", "объект": 'ob"ekt', "Київ": "kiyiv", "Ёж": "iozh", "Ångström": "angstrom", "Großß": "grossss"}
    got = spark.createDataFrame(list(pairs.items()), "a string, b string").select("a", "b", X.fold(F.col("a")).alias("f"), X.tokens(F.col("a")).alias("t")).collect()
    for r in got:
        assert r.f == r.b == X.fold_py(r.a) and r.t == [r.b]
