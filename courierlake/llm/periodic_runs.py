"""Runs of words that repeat with a period, found in each text by way of its longest previous factors.

The suffix array of a batch of texts comes from prefix doubling, where only suffixes that are still equal to others
are sorted again; words are numbered apart for each text, so no factor reaches from one text into another. Texts whose
suffixes all differ within ``2 / 3`` of the least length have no run and are done. For the others the longest common prefixes
give the array of longest previous factors and from it the Lempel-Ziv blocks. Main's extensions around each start
of a block give the runs that touch or cross it; those inside a block are copies of earlier runs, which lie in buckets by their starts.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

#: Words and periods in a run at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def suffix_array(ids: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``ids`` in order, and which of them share at least ``least`` words with another, cut to a power of two.

    Groups of suffixes that are equal in their first ``h`` words are ranked by their place in the order; each round sorts only
    those in groups of several, by the ranks ``h`` words further on.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    long = np.zeros(n, bool)
    if not n:
        return order, long
    slots, keys, h = np.arange(n), ids[order], 1
    rank = np.empty(n, np.int64)
    while True:
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        rank[order[slots]] = slots[first][np.cumsum(new) - 1]
        several = np.diff(np.append(first, len(slots))) > 1
        slots = slots[several[np.cumsum(new) - 1]]
        if h <= least < 2 * h:
            long[order[slots]] = True
        if not len(slots):
            return order, long
        at = order[slots]
        further = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        keys = rank[at] * (n + 1) + further
        o = np.argsort(keys, kind="stable")
        order[slots], keys = at[o], keys[o]
        h *= 2


def common_prefixes(w: list[int], order: list[int]) -> list[int]:
    """The words that each suffix shares with the one before it in ``order``, by the rank of the suffix."""
    n = len(w)
    rank, out, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            most = n - (i if i > j else j)
            while k < most and w[i + k] == w[j + k]:
                k += 1
            out[r] = k
            k -= k > 0
        else:
            k = 0
    return out


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each place the longest factor from there that starts earlier too, and where it does (-1: nowhere).

    Places leave the order from the last to the first, so that a place's neighbours are the nearest earlier ones.
    """
    n = len(order)
    lpf, source = [0] * n, [-1] * n
    lcp = [*lcp, 0]
    before, behind, rank = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = before[r], behind[r]
        up, down = lcp[r], lcp[b]
        if up >= down:
            if up:
                lpf[i], source[i] = up, order[a]
            lcp[b] = down
        else:
            lpf[i], source[i] = down, order[b]
            lcp[b] = up
        if a >= 0:
            behind[a] = b
        if b < n:
            before[b] = a
    return lpf, source


def blocks_of(lpf: list[int]) -> list[int]:
    """Where the Lempel-Ziv blocks start, and the end: a block is the longest previous factor, or one new word."""
    out, i = [0], 0
    while i < len(lpf):
        i += lpf[i] or 1
        out.append(i)
    return out


def prefix_matches(x: list[int]) -> list[int]:
    """How far ``x`` agrees with itself from each place on."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            k = max(k, 0)
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def extended(w: list[int], a: int, b: int, c: int, least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    """Runs ``(start, end, period)`` that touch or cross ``b`` and end behind it, in the block from ``b`` to ``c`` or at its start; ``a`` is
    where the block before starts.

    A run's second period starts in this block or in the one before, as the block that holds its first word repeats all of the
    run from there: all its periods but one. In the first case this block bounds them, and the run starts no more than a period before ``b``. In
    the second both blocks together do, and the run starts no more than a period before ``a``.
    """
    n, out = len(w), []

    def put(start: int, end: int, q: int) -> None:
        if end - start >= least_words and end - start >= least_periods * q and (end < c or end == n or w[end] != w[end - q]):
            out.append((start, end, q))

    most = (c - b) // (least_periods - 1)
    if most:
        ahead = [*prefix_matches(w[b:c]), 0]
        past = w[max(0, b - most - 1) : b][::-1]
        back = prefix_matches([*past, -1, *w[max(0, b - most - 1) : b + most][::-1]])
        for q in range(1, most + 1):
            left = back[len(past) + 1 + most - q]
            if left <= q and left + ahead[q] + q >= least_words:
                put(b - left, b + q + ahead[q], q)
    most = min(b, (c - a) // (least_periods - 1))
    if most:
        ahead = prefix_matches([*w[b:c], -1, *w[b - most : c]])
        back = prefix_matches(w[max(0, b - most - (b - a) - 1) : b][::-1])
        for q in range(1, most + 1):
            right, left = min(ahead[c - b + 1 + most - q], c - b), back[q] if q < len(back) else 0
            if left <= b - a and left + right + q >= least_words:
                put(b - q - left, b + right, q)
    return out


def runs_of(w: list[int], order: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs ``(start, end, period)`` of ``w``, whose suffixes come in ``order``: by start, then period.

    A run is a stretch with smallest period ``period``, of ``least_words`` and ``least_periods`` periods (two or more) at least, which
    no neighbouring word extends. Behind its first period it repeats earlier words, so one or two neighbouring blocks hold that part.
    """
    lpf, source = previous_factors(order, common_prefixes(w, order))
    at = blocks_of(lpf)
    found: dict[tuple[int, int], int] = {}
    buckets: dict[int, list[tuple[int, int]]] = {}

    def put(start: int, end: int, q: int) -> None:
        if (start, end) not in found:
            found[start, end] = q
            insort(buckets.setdefault(start, []), (end, q))

    tail = least_words - least_words // least_periods  # words of a run behind its first period at least
    for k in range(1, len(at)):
        a, b, c = at[k - 1], at[k], at[k + 1] if k + 1 < len(at) else len(w)
        if c - a >= tail:
            for start, end, q in sorted(extended(w, a, b, c, least_words, least_periods), key=lambda r: r[2]):
                put(start, end, q)
        if c - b > least_words:
            shift = b - source[b]
            for start in range(source[b] + 1, c - shift - least_words):
                for end, q in buckets.get(start, ()):
                    if end >= c - shift:
                        break
                    put(start + shift, end + shift, q)
    return sorted((s, e, q) for (s, e), q in found.items())


@dataclass
class Words:
    """The words of a text and their numbers, equal for equal words."""

    words: list[bytes]
    ids: list[int]

    @classmethod
    def of(cls, text: bytes) -> "Words":
        words = text.split()
        known: dict[bytes, int] = {}
        return cls(words, [known.setdefault(x, len(known)) for x in words])


def runs_of_texts(texts: list[Words], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by one suffix array of them all."""
    size = np.array([len(t.ids) for t in texts], np.int64)
    kinds = np.array([max(t.ids, default=-1) + 1 for t in texts], np.int64)
    at = np.cumsum(size) - size
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not size.sum():
        return out
    ids = np.concatenate([np.array(t.ids, np.int64) for t in texts]) + np.repeat(np.cumsum(kinds) - kinds, size)
    order, long = suffix_array(ids, least_words - least_words // least_periods)
    due = np.flatnonzero(np.bincount(np.repeat(np.arange(len(texts)), size)[long], minlength=len(texts)))
    for i in due.tolist():  # suffixes of a text stand together, at its own place
        own = order[at[i] : at[i] + size[i]] - at[i]
        out[i] = runs_of(texts[i].ids, own.tolist(), least_words, least_periods)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by single spaces."""
    done, kept = 0, []
    for s, e in sorted((s + q, e) for s, e, q in runs):
        if s > done:
            kept += words[done:s]
        done = max(done, e)
    return b" ".join([*kept, *words[done:]])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``runs``, ``top_run`` and ``collapsed``.

    Words are runs of bytes outside ASCII white space, numbered from 0, compared as they are. ``runs`` is an array of ``(start, length, period)``
    by start and period: stretches with smallest period ``period`` of at least ``least_words`` words and ``least_periods`` periods, which
    no neighbouring word extends. ``top_run`` is the one with the greatest length in periods, of equals the first, then that with the smaller
    period (null without a run). ``collapsed`` has the words that no run holds behind its first period, joined by single spaces.

    Null and empty texts have no runs and collapse to empty texts; repeated rows give repeated rows; ids and other columns play no part and
    stay, but own columns named like the new ones are replaced; an empty table gives an empty one. Every text is one row's work, so memory
    grows with the longest text.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("runs", "top_run", "collapsed")]
    own = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Words.of(t or b"") for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
            found = runs_of_texts(texts, least_words, least_periods)
            rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in runs] for runs in found]
            best = []
            for runs in rows:
                top = None
                for r in runs:  # a later one must be longer in periods
                    if top is None or r["length"] * top["period"] > top["length"] * r["period"]:
                        top = r
                best.append(top)
            kept = pa.array([collapsed(t.words, r) for t, r in zip(texts, found)], pa.large_binary()).cast(pa.large_string())
            cols = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, pa.list_(_RUN)), pa.array(best, _RUN), kept.cast(pa.string())], names=[*names, "runs", "top_run", "collapsed"])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*own.schema.fields]).add("runs", T.ArrayType(kind)).add("top_run", kind).add("collapsed", "string")
    return own.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with texts in which the end of every tenth repeats its own words: ``h`` is the CRC-32 of the decimal ``doc_id``, ``g`` is
    ``h`` without its last digit; if that digit is 0, each word ``i`` from ``a = g % n`` on becomes word ``a + (i - a) % p``, where ``n`` is the
    number of words and ``p`` is ``1 + (n - a) // (3 + g % 8)``. Words are then joined by single spaces; other texts stay as they are.
    Rows without an id or a word stay as they are; repeated rows change alike; an empty table stays empty."""
    small_batches(docs.sparkSession)
    names = docs.columns
    own = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            for i, h in enumerate(batch.column(len(names)).to_pylist()):
                words = texts[i].split() if h is not None and h % 10 == 0 and texts[i] else None
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[i] = b" ".join([*words[:a], *(words[a : a + p] * (-(-(n - a) // p)))[: n - a]])
            cols = [batch.column(j) for j in range(len(names))]
            cols[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return own.mapInArrow(run, docs.schema)
