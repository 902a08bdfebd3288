"""Toxicity by a factorization machine over hashed terms.

Terms are whole words and word beginnings, hashed to a fixed number of buckets. A machine of second order
gives each term a weight and a short vector; the product of two vectors weighs the pair, so that an insult
next to a group mention can count although neither does alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, small_batches, train_row

#: Buckets that terms hash to, and labelled rows that a model is fitted on at most.
BUCKETS, SAMPLE = 1 << 18, 20_000
#: Terms in a model at most, and the association with the label that one needs (a likelihood ratio).
TERMS, LEAST_G2, LEAST_ROWS = 2_048, 15.0, 4
#: Terms among which pairs are sought: those tied most to the label, and as many of the most evenly spread; what a pair must
#: add to either of its terms (a likelihood ratio, high as millions of pairs are tried), and terms that enter by pairs at most.
PAIRED, LEAST_PAIR, BY_PAIRS = 1_024, 40.0, 256
#: Word beginnings that are terms, in characters.
BEGINNINGS = (4, 5, 6)
REMEMBERED = 300_000
_word = re.compile(r"\w+")


def buckets_of(word: str) -> tuple[int, ...]:
    terms = ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)


class Terms:
    """The terms of texts, as columns of a model or as buckets. Words are remembered, up to a bound."""

    def __init__(self, column: dict[int, int] | None = None):
        self.column, self.known = column, {}

    def of(self, text: str) -> set[int]:
        known, out = self.known, set()
        for w in set(_word.findall(text.lower())):
            got = known.get(w)
            if got is None:
                got = buckets_of(w)
                if self.column is not None:
                    got = tuple(self.column[b] for b in got if b in self.column)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = got
            if got:
                out.update(got)
        return out


@dataclass
class FactorizationMachine:
    column: dict[int, int] = field(default_factory=dict)
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def score(self, terms: list[int]) -> float:
        """The probability of label 1 for a row with these columns: no term leaves the bias."""
        z = self.bias
        if terms:
            v = self.factors[terms]
            z += self.weights[terms].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The ratio of two-by-two tables with rows ``a, b`` and ``c, d``: zero where rows and columns are independent."""
    part = lambda x: x * np.log(np.maximum(x, 1))
    return 2 * (part(a) + part(b) + part(c) + part(d) - part(a + b) - part(c + d) - part(a + c) - part(b + d) + part(a + b + c + d))


def pair_gains(rows: list[np.ndarray], labels: np.ndarray, width: int) -> np.ndarray:
    """For each pair of columns what one tells about the label among rows that have the other, the lesser of both
    ways. It is high for terms that only matter together, and low where one of them does without the other."""
    both = [np.zeros((width, width), np.float32) for _ in (0, 1)]
    for start in range(0, len(rows), 1024):
        for y in (0, 1):
            part = [r for r, label in zip(rows[start : start + 1024], labels[start : start + 1024]) if label == y]
            dense = np.zeros((len(part), width), np.float32)
            for i, r in enumerate(part):
                dense[i, r] = 1
            both[y] += dense.T @ dense
    gains = np.zeros((width, width), np.float32)
    for i in range(width):
        no, yes = both[0][i].astype(float), both[1][i].astype(float)
        gains[i] = likelihood_ratio(yes, no, yes[i] - yes, no[i] - no)
    return np.minimum(gains, gains.T)


def paired_terms(rows: list[np.ndarray], labels: np.ndarray, width: int, most: int = BY_PAIRS) -> list[int]:
    """Columns that are in pairs of at least ``LEAST_PAIR``, those of the strongest pairs, in order."""
    gains = np.triu(pair_gains(rows, labels, width), 1)
    a, b = np.nonzero(gains >= LEAST_PAIR)
    found: dict[int, None] = {}
    for k in np.argsort(-gains[a, b], kind="stable"):
        if len(found) + 2 > most:
            break
        found |= {int(a[k]): None, int(b[k]): None}
    return sorted(found)


def train(rows: list[np.ndarray], labels: np.ndarray, width: int, rank: int = 8, steps: int = 2_500, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the log loss with a quadratic penalty, in as many steps for few
    rows as for many; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean())
    if not 0 < share < 1:
        return (40.0 if share else -40.0), np.zeros(width), np.zeros((width, rank))
    flat = [np.asarray(r, np.int64) for r in rows]
    w, v, b = np.zeros(width), rng.normal(0, 0.02, (width, rank)), 0.0
    moments = [np.zeros_like(x) for x in (w, w, v, v)]
    mb = sb = 0.0
    step, queue = 0, []
    while step < steps:
        queue = queue or np.array_split(rng.permutation(len(rows)), -(-len(rows) // 512))
        part = queue.pop()
        step += 1
        ix, of = np.concatenate([flat[i] for i in part]), np.repeat(np.arange(len(part)), [len(flat[i]) for i in part])
        vx = v[ix]
        total = np.stack([np.bincount(of, vx[:, k], len(part)) for k in range(rank)], axis=1)
        z = b + np.bincount(of, w[ix], len(part)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(of, (vx**2).sum(axis=1), len(part)))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part)
        gw = np.bincount(ix, g[of], width) + 1e-5 * w
        each = g[of, None] * (total[of] - vx)
        gv = np.stack([np.bincount(ix, each[:, k], width) for k in range(rank)], axis=1) + 1e-4 * v
        for x, d, (p, q) in ((w, gw, (0, 1)), (v, gv, (2, 3))):
            moments[p] += 0.1 * (d - moments[p])
            moments[q] += 0.01 * (d * d - moments[q])
            x -= 0.02 * (moments[p] / (1 - 0.9**step)) / (np.sqrt(moments[q] / (1 - 0.99**step)) + 1e-8)
        gb = float(g.sum())
        mb += 0.1 * (gb - mb)
        sb += 0.01 * (gb * gb - sb)
        b -= 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    return b, w, v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """A model from rows whose labels may be learnt (``train_row``).

    At most ``sample`` labelled rows are used, those with the smallest hashes of their ids, so the model's
    cost is bounded; terms are counted over all of these. Those tied to the label enter the model, and those that
    tell about it in pairs (``paired_terms``), though they may be balanced over the labels alone.
    Null labels, ids without a document and documents without a label are left out. An id that is
    labelled more than once has the greatest of its labels. Without any labelled row the score is 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(train_row()).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size is bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen, rows = Terms(), np.zeros((2, BUCKETS + 1), np.int64), 0
        for batch in batches:
            for y, t in zip(*columns(batch, "y", "text")):
                found = terms.of(t or "")
                seen[int(y > 0), [*found, BUCKETS]] += 1  # the last bucket counts rows
                rows += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "no", "yes"])

    seen = texts.mapInArrow(count, "bucket int, no bigint, yes bigint").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    total = seen.where(F.col("bucket") == BUCKETS).first()
    if total is None:
        return FactorizationMachine()
    n, yes = total.no + total.yes, total.yes
    both = F.col("no") + F.col("yes")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (share * n))).otherwise(0.0)
    p, q = both / n, yes / n
    g2 = 2 * (part(F.col("yes"), p * q) + part(F.col("no"), p * (1 - q)) + part(yes - F.col("yes"), (1 - p) * q) + part(n - yes - F.col("no"), (1 - p) * (1 - q)))
    tied = F.col("g2") >= LEAST_G2
    enough = seen.where((F.col("bucket") < BUCKETS) & (both >= LEAST_ROWS)).withColumn("g2", g2).select("bucket", "g2", (both * (n - both)).alias("spread"), tied.alias("tied"))
    first = enough.where("tied").orderBy(F.desc("g2"), "bucket").limit(TERMS).collect()
    more = enough.where("not tied").orderBy(F.desc("spread"), "bucket").limit(PAIRED).collect()
    # The terms for pairs stand together: those tied most, then the balanced ones, whose room the tied ones never take.
    at = min(len(first), PAIRED)
    column = {r.bucket: i for i, r in enumerate([*first[at:], *first[:at], *more])}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(column)
        for batch in batches:
            ys, ts = columns(batch, "y", "text")
            yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y in ys], pa.int32()), pa.array([np.array(sorted(terms.of(t or "")), "<i4").tobytes() for t in ts], pa.binary())], names=["y", "terms"])

    found = texts.mapInArrow(pick, "y int, terms binary").toArrow()  # no more rows and terms than the bounds above
    pairs = sorted(zip(found.column("y").to_pylist(), found.column("terms").to_pylist()))
    rows, ys = [np.frombuffer(t, "<i4") for _, t in pairs], np.array([y for y, _ in pairs], float)
    apart = len(first) - at
    sought = [r[r >= apart] - apart for r in rows]
    used = sorted({*range(len(first)), *(apart + i for i in paired_terms(sought, ys, len(column) - apart))})
    at = np.full(len(column), -1)
    at[used] = np.arange(len(used))
    held = [at[r][at[r] >= 0] for r in rows]
    b, w, v = train(held, ys, len(used))
    return FactorizationMachine({bucket: int(at[i]) for bucket, i in column.items() if at[i] >= 0}, b, w, v)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id`` and ``score`` of every row by its whole text. Null and empty texts have no terms and get the
    score of the bias; repeated rows score alike; labels and other columns play no part."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        terms = Terms(fm.column)
        for batch in batches:
            (texts,) = columns(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fm.score(sorted(terms.of(t or ""))) for t in texts])], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: FactorizationMachine, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, with the same columns; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        terms = Terms(fm.column)
        for batch in batches:
            keep = [fm.score(sorted(terms.of(t or ""))) < least for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
