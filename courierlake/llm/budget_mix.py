"""Mixing sources to target weights by fitting word budgets exactly.

For each source the documents are counted by exact length. A budget of words becomes a number of whole
passes over the source and a rest; of the rest each length gets its share of documents, rounding is carried from length to length, and what
it leaves in the end, less than the longest document, is filled by a bounded knapsack over the lengths that have documents to spare. Which documents of a
length are taken follows a seeded hash, found from counts by hash range, so no task ranks a whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, fewer, settled, small_batches

#: Weights of the sources in order, repeating; the share of all words that targets sum to; the most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
SEED = 17


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> dict[str | None, float]:
    """Words meant for each source. Sources in the order of their code points, null last, weigh ``weights`` in
    turn and split ``share`` of all words; a target stops at ``passes`` times its source, and what is above
    is split again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > passes * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(passes * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length sum to the most words that don't exceed ``budget``, by dynamic programming over
    sums: a length that occurs ``c`` times is split into 1, 2, 4, ... of it, and each sum remembers the first
    part that reached it."""
    taken = np.zeros(len(lengths), np.int64)
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        left, two = int(min(counts[i], budget // lengths[i] if lengths[i] > 0 else 0)), 1
        while left > 0:
            parts.append((int(i), min(two, left)))
            left, two = left - min(two, left), two * 2
    reached, by = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32)
    reached[0] = True
    for j, (i, c) in enumerate(parts):
        words = int(lengths[i]) * c
        if words <= budget:
            new = np.flatnonzero(reached[: budget + 1 - words] & ~reached[words:]) + words
            reached[new], by[new] = True, j
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, c = parts[by[at]]
        taken[i] += c
        at -= int(lengths[i]) * c
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for ``budget`` words: the same share of every length, then a knapsack.

    From short to long, each length takes the most documents that keep the words taken at or below the share of all words so far. So
    what rounding leaves of one length goes to the next, less than a document of it is left each time, and in the end
    less than the longest document: that is what the knapsack fills, from all documents that are to spare. Of more than half of all words the
    documents that stay out are fitted in this way, so that there are always enough to choose from."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:
        return counts - fit_budget(lengths, counts, total - budget)
    taken, words, due = np.zeros(len(lengths), np.int64), 0, 0
    for i in np.argsort(lengths, kind="stable"):
        n = int(lengths[i])
        if n > 0:
            words += n * int(counts[i])
            taken[i] = min(int(counts[i]), (words * budget // total - due) // n)
            due += n * int(taken[i])
    left = budget - due
    return taken + knapsack(lengths, np.where((lengths > 0) & (lengths <= left), counts - taken, 0), left)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """How often each row of ``docs`` enters the mix.

    Returns a row for each row: ``doc_id``, ``key`` (a seeded hash of id and text), ``size`` (words),
    ``source_size``, ``target`` and ``copies`` (0 to ``passes``). Null and empty texts have no words and
    no copies. A null source is a source, the last. Of repeated rows, which are alike in everything, any
    may be the one taken. Equal tables give equal copies. An empty table gives an empty one. Other columns
    play no part. One total for each source goes to the driver; lengths and their counts stay distributed.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch, "text")
            # In bytes, split cuts at just the white space that parts words here: 9 to 13 and 32.
            words = pa.array([len(t.encode().split()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, batch.column(3)], names=["doc_id", "source", "size", "key"])

    held = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("key"))
    rows = settled(held.mapInArrow(count, "doc_id bigint, source string, size bigint, key bigint"))
    sizes = {r.source: r.words for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    aims = targets(sizes, weights, share, passes)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lengths, counts = (np.array([x[k] for x in found], np.int64) for k in ("size", "n"))
                whole, rest = divmod(round(aims[source]), sizes[source]) if sizes[source] else (0, 0)
                more = fit_budget(lengths, counts, rest)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * n, pa.string()), pa.array(lengths), pa.array([whole] * n, pa.int64()), pa.array(counts), pa.array(more), pa.array([sizes[source]] * n, pa.int64()), pa.array([aims[source]] * n, pa.float64())],
                    names=["source", "size", "whole", "n", "more", "source_size", "target"],
                )

    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    each = counts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("lengths"))
    plan = settled(each.mapInArrow(fit, "source string, size bigint, whole bigint, n bigint, more bigint, source_size bigint, target double"))

    # Where some documents of a length are taken, they are those with the smallest keys: whole ranges of keys, and a part of one.
    ranged = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 52).cast("int")
    some = fewer(plan.where("more > 0 and more < n").select(F.col("source").alias("s"), F.col("size").alias("z"), "more"))
    on = rows["source"].eqNullSafe(some["s"]) & (rows["size"] == some["z"])
    split = rows.join(some, on).select("s", "z", "more", ranged.alias("range")).groupBy("s", "z", "range").agg(F.count("*").alias("c"), F.first("more").alias("more"))
    lists = split.groupBy("s", "z").agg(F.sort_array(F.collect_list(F.struct("range", "c"))).alias("l"), F.first("more").alias("more"))
    edge = F.expr("""aggregate(l, named_struct('sum', 0L, 'at', -1, 'left', 0L), (a, x) -> if(a.at >= 0, a,
        if(a.sum + x.c >= more, named_struct('sum', a.sum, 'at', x.range, 'left', more - a.sum), named_struct('sum', a.sum + x.c, 'at', -1, 'left', 0L))))""")
    edges = lists.select("s", "z", edge.alias("e")).select("s", "z", F.col("e.at").alias("at"), F.col("e.left").alias("left"))
    planned = fewer(settled(plan.join(edges, plan["source"].eqNullSafe(edges["s"]) & (plan["size"] == edges["z"]), "left").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "whole", "n", "more", "source_size", "target", "at", "left"
    )))  # written, so that the join with the rows has exchanges of its own and splits hot lengths
    held = rows.join(planned, rows["source"].eqNullSafe(planned["s"]) & (rows["size"] == planned["z"])).withColumn("range", ranged)
    at_edge = F.coalesce(F.col("range") == F.col("at"), F.lit(False))
    sure = F.when(F.col("more") == 0, 0).when(F.col("more") == F.col("n"), 1).when(F.col("range") < F.col("at"), 1).otherwise(0)
    out = ("doc_id", "key", "size", "source_size", "target")
    ranked = held.where(at_edge).withColumn("rank", F.row_number().over(Window.partitionBy("s", "z").orderBy(F.col("key").bitwiseXOR(F.lit(-(2**63))), "doc_id")))
    copies = lambda taken: F.when(F.col("size") > 0, F.col("whole") + taken).otherwise(0).cast("int").alias("copies")
    return held.where(~at_edge).select(*out, copies(sure)).union(ranked.select(*out, copies(F.when(F.col("rank") <= F.col("left"), 1).otherwise(0))))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as they enter the mix, with the same columns. Rows that are equal in id and
    text are taken for one document here and are repeated as the first of them is."""
    names = docs.columns
    seed = options.get("seed", SEED)
    found = mix(docs, **options).where("copies > 0").groupBy(F.col("key").alias("__key")).agg(F.max("copies").alias("__copies"))
    held = docs.withColumn("__key", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")).join(found, "__key")
    return held.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*names)
