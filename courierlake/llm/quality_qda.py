"""Document quality by a regularised quadratic discriminant.

Each text becomes a few transformed statistics. Counts, sums and products of the statistics of all labelled
rows give a mean and a covariance for each class; covariances shrink to their pooled form and to a multiple
of the identity. A score is the difference of the two log-densities, whose Mahalanobis distances come from
Cholesky factors that are computed once and sent to the executors.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, settled, small_batches, train_row

#: Weight of a class's own covariance against the pooled one, and of the identity against both.
OWN, IDENTITY = 0.8, 0.02
TABLE = 0x250  # code points whose kind is looked up; those above count as lower-case letters
LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL = range(6)


def _kind(c: str) -> int:
    if c in ".,;:?'\"()-":
        return STOP
    cat = unicodedata.category(c)
    return UPPER if cat == "Lu" else LOWER if cat[0] in "LM" else DIGIT if cat[0] == "N" else SPACE if c.isspace() or cat[0] == "Z" else SYMBOL


KINDS = np.array([_kind(chr(i)) for i in range(TABLE)] + [LOWER], np.uint8)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: lengths as logarithms, shares as logarithms of share and a little."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    by = np.bincount(KINDS[np.minimum(codes, TABLE)], minlength=6).astype(float)
    seen = max(1.0, len(codes) - by[SPACE])
    words = text.split()
    n = len(words)
    times = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(lines)
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lengths = np.fromiter(map(len, words), float, n)
    share = lambda x, of, least: float(np.log(x / max(1.0, of) + least))
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        share(by[UPPER], seen, 0.01),
        share(by[DIGIT], seen, 0.01),
        share(by[STOP], seen, 0.01),
        share(by[SYMBOL], seen, 0.005),
        share(n - len(times), n, 0.05),
        share(again, n, 0.01),
        share(max(times.values(), default=0), n, 0.02),
        share((n - 1) - pairs if n > 1 else 0, n, 0.02),
        share(k - len(set(lines)), k, 0.05),
        float(np.log1p(n / k)) if k else 0.0,
        share(sum(x.rstrip()[-1:] in ".!?" for x in lines), k, 0.1),
        share(sum(w[-1] in "!%$&*#|" for w in words), n, 0.01),
        share(sum(len(w) == 1 and not w.isalnum() for w in words), n, 0.01),
    ]


WIDTH = len(statistics(""))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-densities' constants of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if not len(x):
            return np.zeros(0)
        far = [(((x - self.means[y]) @ self.factors[y].T) ** 2).sum(axis=1) for y in (0, 1)]
        z = self.constants[1] - self.constants[0] - 0.5 * (far[1] - far[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """A model from the number of rows, the sums and the products of both classes. A class without rows gets
    the other's mean and covariance, so that the shares of the classes decide; without any row scores are 0.5."""
    d = sums.shape[1]
    pooled = np.zeros((d, d))
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for y in (0, 1):
        if n[y]:
            means[y] = sums[y] / n[y]
            covs[y] = products[y] / n[y] - np.outer(means[y], means[y])
            pooled += covs[y] * n[y] / n.sum()
    for y in (0, 1):
        if not n[y]:
            means[y], covs[y] = means[1 - y], covs[1 - y]
    factors, constants = [], []
    scale = np.maximum(np.diag(pooled), 1e-6)  # the identity in units of each statistic
    for y in (0, 1):
        weight = OWN * n[y] / (n[y] + d)  # a class of few rows leans on the pooled covariance
        cov = (1 - IDENTITY) * (weight * covs[y] + (1 - weight) * pooled) + IDENTITY * np.diag(scale)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(np.log((n[y] + 0.5) / (n.sum() + 1)) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics ``x`` of every row; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t or "") for t in texts], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


def fit(measured: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    """A model from all rows whose labels may be learnt (``train_row``). Null labels and ids without a partner
    are left out; an id with several labels has the greatest. Only sums go to the driver."""
    known = labels.where(train_row()).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    size = 1 + WIDTH + WIDTH * WIDTH

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            ys, xs = columns(batch, "y", "x")
            for y in (0, 1):
                if own := [x for x, z in zip(xs, ys) if (z > 0) == y]:
                    m = np.array(own)
                    total[y] += np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["at", "sum"])

    total = np.zeros(2 * size)
    for r in measured.join(known, "doc_id").select("y", "x").mapInArrow(add, "at bigint, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        total[r["at"]] = r["sum"]
    total = total.reshape(2, size)
    return discriminant(total[:, 0], total[:, 1 : 1 + WIDTH], total[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id`` and ``score`` of every row by its whole text, learnt from ``labels``.

    Null and empty texts have the statistics of an empty text and are scored like any other; repeated rows
    score alike; an empty table gives an empty one. Statistics are computed once and kept in the shared
    folder, 16 numbers for a row. Labels and other columns are no inputs of a score.
    """
    measured = settled(measure(docs))
    sent = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs,) = columns(batch, "x")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(np.array(xs).reshape(-1, WIDTH)), pa.float64())], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id bigint, score double")
