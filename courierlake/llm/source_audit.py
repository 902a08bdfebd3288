"""How sources differ from each other and from their language, in exact whole numbers.

Terms are counted in one pass that sums within each batch. Of a language's kept terms a source mostly lacks many, and all that it lacks
have one share, its baseline. So the divergence of two sources is that of their baselines for every kept term, corrected for the terms
that one of them has (by a histogram of its counts) and again for those that both have (from each term's own list of sources).
The terms that stand out in a source are found by radix selection: histograms over the bits of the values give each
group's kth value, and ties there are refined by their UTF-8 bytes, so no group is ever sorted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, fewer, settled, small_batches

#: Documents of a language that a kept term is in at least, and terms that are reported of a group.
LEAST_DOCS, TOP = 10, 10
#: Shares are counted in parts of this number.
UNIT = 1_000_000_000
#: Bits of a digit of the selection, and pairs of sources that a task sums at once.
DIGIT, PAIRS = 8, 1 << 20
#: Terms of its groups that a task holds before it sends their counts on, and what stands for a document next to occurrences.
HELD, ONE_DOC = 500_000, 1 << 40
#: Letters in lower case and bytes of characters beyond ASCII stay, all else parts terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents (rows) of each term, summed within tasks but not yet between
    them. Each group also has a row with the empty term, whose counts are zero. Null texts, languages and sources are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, dict[bytes, int]] = {}  # a number holds occurrences and, above them, documents

        def flush() -> Iterator[pa.RecordBatch]:
            for group, terms in found.items():
                n = np.fromiter(terms.values(), np.int64, len(terms))
                names = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in group]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(n % ONE_DOC), pa.array(n // ONE_DOC)], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*columns(batch, "lang", "source", "text")):
                terms = Counter(text.translate(_TERM).split(b" "))
                del terms[b""]
                held = found.setdefault((lang, source), {b"": 0})
                of = held.get
                for t, c in terms.items():
                    held[t] = of(t, 0) + ONE_DOC + c
            if sum(map(len, found.values())) > HELD:
                yield from flush()
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """One and ``UNIT * (n + 2) / (total + 2 * terms)``, cut to a whole number; exact, as the product is a decimal."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    whole = F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(11,0)"), F.nullif((total + 2 * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))
    return F.lit(1) + F.coalesce(whole, F.lit(0).cast("long"))


def divergence(p: Column | str, q: Column | str) -> Column:
    """The square of the difference of two shares over their sum, cut to a whole number."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def _digit(chosen: DataFrame, by: list[str], down: bool) -> DataFrame:
    """For each group the digit in which its kth row lies, how many rows lie before it and how many in it, from ``by``, ``digit`` and ``k``.

    A group's histogram has no more bins than a digit has values.
    """
    bins = chosen.groupBy(*by, "k", "digit").agg(F.count("*").alias("inside"))
    w = Window.partitionBy(*by).orderBy(F.desc("digit") if down else F.asc("digit")).rowsBetween(Window.unboundedPreceding, 0)
    through = bins.withColumn("through", F.sum("inside").over(w)).where("through >= k")
    first = through.groupBy(*by, "k").agg(F.min_by(F.struct("digit", "through", "inside"), "through").alias("b"))
    return first.select(*by, F.col("b.digit").alias("digit"), (F.col("k") - (F.col("b.through") - F.col("b.inside"))).alias("need"), F.col("b.inside").alias("inside"))


def select_top(rows: DataFrame, by: list[str], value: str, item: str, k: int = TOP) -> DataFrame:
    """The ``k`` rows of each group ``by`` with the greatest ``value``, of equal ones those whose ``item`` comes first by its UTF-8 bytes.

    ``rows`` has whole numbers from zero on as values, and items that are distinct within a group (of equal rows all come, if one does).
    Groups with fewer rows come whole; none is sorted or gathered: each round counts digits. A null value or item isn't
    allowed. An empty table gives an empty one.
    """
    rows = settled(rows)
    top = rows.agg(F.max(value)).first()[0] or 0
    shift = (max(1, top.bit_length()) - 1) // DIGIT * DIGIT
    state = None  # by, prefix (the digits known of the kth value), need (rows wanted among those that share them), inside (their number)
    while shift >= 0:
        digit = F.shiftright(F.col(value), shift).bitwiseAND((1 << DIGIT) - 1)
        if state is None:
            now = rows.select(*by, F.lit(k).cast("long").alias("k"), digit.alias("digit"))
            state = settled(_digit(now, by, True).withColumnRenamed("digit", "prefix"))
        else:
            here = rows.join(fewer(state), by).where(F.shiftright(F.col(value), shift + DIGIT) == F.col("prefix"))
            found = _digit(here.select(*by, "prefix", F.col("need").alias("k"), digit.alias("digit")), [*by, "prefix"], True)
            state = settled(found.select(*by, (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix"), "need", "inside"))
        shift -= DIGIT
    few = fewer(state)
    above = rows.join(few, by, "left").where(F.col("prefix").isNull() | (F.col(value) > F.col("prefix")) | ((F.col(value) == F.col("prefix")) & (F.col("need") >= F.col("inside"))))
    tied = rows.join(few.where("need < inside"), by).where(F.col(value) == F.col("prefix"))
    out = [above.select(rows.columns)]
    tied = settled(tied.select(*rows.columns, F.col("need").alias("__k")))
    while not tied.isEmpty():
        # The longest beginning that all the tied items of a group share is passed over at once.
        ends = tied.groupBy(*by).agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
        lo, hi = (F.encode(F.col(c), "UTF-8") for c in ("lo", "hi"))
        same = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), F.octet_length("lo") + 1), lambda i: F.substring(lo, i, F.lit(1)) == F.substring(hi, i, F.lit(1))), False), F.lit(1))
        at = fewer(settled(ends.select(*by, same.alias("__at"))))
        here = tied.join(at, by)
        byte = F.conv(F.hex(F.substring(F.encode(F.col(item), "UTF-8"), F.col("__at"), F.lit(1))), 16, 10).cast("int")
        digit = F.when(F.octet_length(item) < F.col("__at"), F.lit(-1)).otherwise(byte)
        here = here.withColumn("__d", digit.cast("long"))
        cut = fewer(settled(_digit(here.select(*by, F.col("__k").alias("k"), F.col("__d").alias("digit")), by, False)))
        dealt = settled(here.join(cut, by))
        whole = F.col("need") >= F.col("inside")
        out.append(dealt.where((F.col("__d") < F.col("digit")) | ((F.col("__d") == F.col("digit")) & whole)).select(rows.columns))
        tied = settled(dealt.where((F.col("__d") == F.col("digit")) & ~whole).select(*rows.columns, F.col("need").alias("__k")))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def _shared_terms(vectors: DataFrame) -> DataFrame:
    """What the pairs of sources ``a < b`` get for terms that both have, from each term's ``own`` (source, share, baseline), in the order of sources."""

    def reduced(lang: str, names: list[str], keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at.ravel(), np.concatenate(values))
        a, b = np.divmod(key, len(names))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(total)], names=["lang", "a", "b", "value"])

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            own = batch.column(1)
            for lang in dict.fromkeys(langs.tolist()):
                lists = own.filter(pa.array(langs == lang))
                flat = lists.flatten()
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                code = flat.field(0).dictionary_encode()
                names, who = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                p, base = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                left = np.repeat(np.cumsum(size), size) - np.arange(len(flat)) - 1  # entries behind each in its term
                keys, values, held = [], [], 0
                for step in range(1, int(size.max(initial=0))):
                    i = np.flatnonzero(left >= step)
                    for part in np.array_split(i, -(-len(i) // PAIRS)):
                        a, b = part, part + step
                        keys.append(who[a] * len(names) + who[b])
                        values.append(f(p[a], p[b]) - f(p[a], base[b]) - f(base[a], p[b]) + f(base[a], base[b]))
                        held += len(part)
                        if held >= PAIRS:
                            yield reduced(lang, names, keys, values)
                            keys, values, held = [], [], 0
                if keys:
                    yield reduced(lang, names, keys, values)

    return vectors.mapInArrow(run, "lang string, a string, b string, value bigint")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` for each group of language and source.

    Terms are runs of ASCII letters (A-Z in lower case) and characters beyond ASCII; a language keeps those that at least ``least_docs`` of its
    rows hold. The share of a term is counted with two occurrences more than there are. Part ``pair`` has the divergence from
    each other source of the language, summed over all its kept terms; part ``term`` the ``top`` terms that the group has and that have a
    greater share there than in the language. Ranks go by value, then by the UTF-8 bytes of the item.

    Null languages, sources and texts are empty ones; groups without a term count. Repeated rows count as often as they are there; ids and other
    columns play no part. A language with one source has no pairs. An empty table gives an empty one. A term's list has no more entries
    than its language has sources, as has a group in part ``pair``.
    """
    small_batches(docs.sparkSession)
    summed = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = summed.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("own"))
    kept = settled(by_term.where((F.col("term") == "") | (F.col("docs") >= least_docs)).select("lang", "term", "lang_n", "own"))
    terms = kept.where("term != ''")
    entries = terms.select("lang", "term", "lang_n", F.inline("own"))
    size = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = entries.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = kept.where("term = ''").select("lang", F.inline("own")).drop("n").join(size, "lang", "left").join(own, GROUP, "left").na.fill(0)
    groups = settled(groups.select(*GROUP, "terms", "total", "lang_total", share(F.lit(0).cast("long"), "total", "terms").alias("base")))
    few = fewer(groups)

    scored = settled(entries.join(few, GROUP).select(*GROUP, "term", "n", share("n", "total", "terms").alias("p"), "base", share("lang_n", "lang_total", "terms").alias("q")))
    standing = scored.where("p > q").select(*GROUP, F.col("term").alias("item"), divergence("p", "q").alias("value"))
    term_part = _ranked(select_top(standing, GROUP, "value", "item", top), "term")

    # Pairs: the baselines for all terms, then corrections for the terms that a has, that b has, and that both have.
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("base").alias(f"base_{x}"), *(["terms"] if x == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a != b").select("lang", "a", "b", (F.col("terms") * divergence("base_a", "base_b")).alias("value"))
    shares = scored.groupBy(*GROUP, "p", "base").agg(F.count("*").alias("times"))
    lone = shares.select("lang", F.col("source").alias("a"), "p", F.col("base").alias("base_a"), "times").join(fewer(side("b")), "lang").where("a != b")
    lone = lone.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * (divergence("p", "base_b") - divergence("base_a", "base_b"))).alias("value"))
    both = _shared_terms(scored.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("own")).select("lang", "own"))
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    swapped = lambda x: x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    value = pairs.union(lone).union(swapped(lone)).union(both).union(swapped(both)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair_part = _ranked(value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"), "pair")
    return pair_part.union(term_part)
