"""Near-duplicate embeddings by cross-polytope hashing.

Three rounds of random signs and fast Hadamard transforms rotate a vector; its hash is the nearest of the
axes, with sign. A table joins a few such hashes to a bucket, more for more vectors. Vectors are kept in
their own bucket of each table and also look into the next likely ones. What meets in a bucket is verified in double
precision. A pair is counted in the first table where it meets, which both vectors can tell, so buckets
return counts and spanning links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import apart, columns, settled, small_batches, unsized
from .words import mixed_bits

#: Tables with two hashes; each further hash doubles them, as it makes a near pair meet about half as often.
TABLES, PROBES = 6, 4
#: Buckets for each vector at least, so that vectors seldom meet by chance however many there are.
ROOM = 32
#: Vectors of a bucket that are compared with each other at once; larger buckets are split into pairs of blocks.
BLOCK = 256
SEED = 23


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, without scale; the width is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        v = x.reshape(len(x), -1, 2, h)
        x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


@dataclass
class CrossPolytope:
    """The hash functions for vectors of ``dim`` numbers."""

    dim: int
    hashes: int = 2
    tables: int = TABLES
    probes: int = PROBES
    seed: int = SEED

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Buckets of unit vectors: vectors x tables x probes, the own bucket first.

        Probes change one of the hashes to the next nearest axes, in the order of what that loses."""
        width = 1 << max(1, (self.dim - 1).bit_length())
        padded = np.zeros((len(x), width))
        padded[:, : self.dim] = x
        rng = np.random.default_rng(self.seed)
        out = np.zeros((len(x), self.tables, self.probes), np.int64)
        depth = min(self.probes, 2 * width)
        for t in range(self.tables):
            ranks, losses = [], []
            for _ in range(self.hashes):
                y = padded
                for _ in range(3):
                    y = hadamard(y * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
                both = np.concatenate([y, -y], axis=1)
                best = np.argpartition(-both, depth - 1, axis=1)[:, :depth] if depth < both.shape[1] else np.broadcast_to(np.arange(depth), both.shape)
                top = np.take_along_axis(both, best, axis=1)
                order = np.argsort(-top, axis=1, kind="stable")
                best, top = np.take_along_axis(best, order, axis=1), np.take_along_axis(top, order, axis=1)
                ranks.append(best)
                losses.append(top[:, :1] - top)
            own = np.zeros(len(x), np.int64)
            for best in ranks:
                own = own * (2 * width) + best[:, 0]
            options, costs = [own], [np.full(len(x), -1.0)]
            for j in range(self.hashes):
                scale = (2 * width) ** (self.hashes - 1 - j)
                for d in range(1, depth):
                    options.append(own + (ranks[j][:, d] - ranks[j][:, 0]) * scale)
                    costs.append(losses[j][:, d])
            order = np.argsort(np.stack(costs, axis=1), axis=1, kind="stable")[:, : self.probes]
            out[:, t, : order.shape[1]] = np.take_along_axis(np.stack(options, axis=1), order, axis=1)
            out[:, t, order.shape[1] :] = own[:, None]
        return out


def bucket_keys(buckets: np.ndarray, dim: int) -> np.ndarray:
    """64-bit hashes of vector length, table and bucket: what two vectors have in common where they meet."""
    table = np.arange(buckets.shape[1], dtype=np.uint64)[None, :, None]
    return mixed_bits(mixed_bits(buckets.astype(np.uint64) + (table + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(dim))


def met_before(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether the vectors with buckets ``a`` and ``b`` (pairs x tables x probes) meet in a table before."""
    out = np.zeros(len(a), bool)
    for t in range(table):
        out |= (a[:, t] == b[:, t, :1]).any(axis=1) | (b[:, t] == a[:, t, :1]).any(axis=1)
    return out


def near_pairs(x: np.ndarray, codes: np.ndarray, own: np.ndarray, table: int, least: float, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """New pairs of rows from ``left`` and ``right`` with a cosine of ``least`` or more, of which one has its
    own bucket here. ``same``: both are the same rows, and each pair counts once.

    Two rows that look into each other's buckets meet twice in a table; the bucket of the first row counts.
    """
    cos = x[left] @ x[right].T
    hit = (cos >= least) & (own[left][:, None] | own[right][None, :])
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    a, b = left[i], right[j]
    host, guest = np.where(own[a], a, b), np.where(own[a], b, a)
    twice = ~own[guest] & (codes[host, table, 1:] == codes[guest, table, :1]).any(axis=1)
    fresh = ~(twice & (host > guest)) & ~met_before(codes[a], codes[b], table)
    return a[fresh], b[fresh]


def settings(n: int, dim: int) -> tuple[int, int]:
    """Hashes of a table and tables for ``n`` vectors."""
    axes, hashes = 2 << max(1, (dim - 1).bit_length()), 2
    while axes**hashes < ROOM * n and axes ** (hashes + 1) < 2**62:
        hashes += 1
    return hashes, TABLES << (hashes - 2)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(x: np.ndarray, codes: np.ndarray, own: np.ndarray, mine: np.ndarray, w: np.ndarray, c: np.ndarray, table: int, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a bucket (or a pair of its blocks) that have new links: their ids, the links by weight, and the
    first id that they hang together with."""
    a, b = near_pairs(x, codes, own, table, least, np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j)
    links = np.bincount(a, w[b], len(c)) + np.bincount(b, w[a], len(c))
    label = np.arange(len(c))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    seen = np.flatnonzero(links)
    return c[seen], links[seen].astype(np.int64), c[label[seen]]


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", value: str = "embedding", probes: int = PROBES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``key``, ``n_links`` and ``component_id`` of each row.

    Rows link if they meet in a bucket and their cosine in double precision is ``least`` or more; equal
    vectors always link. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    key reachable, itself included. Vectors that are null, empty or zero or hold null or non-finite numbers
    link with nothing, nor do vectors of different lengths with each other. Equal vectors are compared once
    and weigh as many rows as they have. A null key takes part but is never the smallest. An empty table
    gives an empty one. Other columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(value).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    classes = settled(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("w")))
    n = classes.count()

    kind = np.float32 if dict(vectors.dtypes)[value] == "array<float>" else np.float64  # as exact as the column, no wider

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (vs,) = columns(batch, "v")
            xs, keys, codes = [b""] * len(vs), [None] * len(vs), [b""] * len(vs)
            for dim in {len(x) for x in vs}:
                at = [i for i, x in enumerate(vs) if len(x) == dim]
                x = np.array([vs[i] for i in at], float)
                hashes, tables = settings(n, dim)
                found = bucket_keys(CrossPolytope(dim, hashes, tables, probes, seed).buckets(unit(x)), dim)
                for i, y, z in zip(at, x.astype(kind), found):
                    xs[i], keys[i], codes[i] = y.tobytes(), z.view(np.int64).ravel(), (z >> np.uint64(32)).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(xs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary())], names=[*batch.schema.names, "x", "keys", "codes"])

    coded = classes.mapInArrow(hashed, "v array<double>, least_id bigint, w bigint, x binary, keys array<bigint>, codes binary")
    coded = settled(coded.withColumn("c", F.monotonically_increasing_id()))

    # Only ids go to the buckets at first; vectors follow where a bucket holds two or more.
    entries = coded.select("c", "keys", F.posexplode("keys").alias("at", "key")).select("c", "key", F.floor(F.col("at") / probes).cast("int").alias("t"), (F.col("at") % probes == 0).alias("own"), F.element_at("keys", (F.floor(F.col("at") / probes) * probes + 1).cast("int")).alias("home"))
    entries = entries.where("own or key != home").drop("home")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    # A bucket of several blocks becomes all pairs of them, each with its own part of the work.
    sizes = sizes.select(apart("key").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = entries.withColumn("k", apart("key")).join(unsized(sizes), "k").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "t", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "c", "own", "mine")
    full = unsized(placed).join(coded.select("c", "x", "codes", "w"), "c").withColumn("codes", F.expr(f"substring(codes, 1, (t + 1) * {4 * probes})"))
    work = ["key", "t", "i", "j"]
    dealt = full.repartition(*work).sortWithinPartitions(*work, "c").select(*work, "c", "own", "mine", "w", "x", "codes")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(10)))

        for (_, t, i, j), group in itertools.groupby(rows_of(), key=lambda r: r[:4]):
            _, _, _, _, c, own, mine, w, x, codes = zip(*group)
            if len(c) > 1:
                y = unit(np.frombuffer(b"".join(x), kind).reshape(len(c), -1).astype(float))
                found = compare(y, np.frombuffer(b"".join(codes), "<u4").reshape(len(c), -1, probes), np.array(own), np.array(mine), np.array(w), np.array(c), t, i, j, least)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["c", "links", "first"])

    found = settled(dealt.mapInArrow(links_of, "c bigint, links bigint, first bigint"))
    of = connected_components(found.select(F.col("c").alias("a"), F.col("first").alias("b")))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    joined = coded.join(unsized(links), "c", "left").join(unsized(of.withColumnRenamed("node", "c")), "c", "left")
    joined = joined.select("v", "least_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"))
    ids = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.withColumn("k", apart("component")).join(unsized(ids.select(apart("component").alias("k"), "component_id")), "k").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(unsized(named), "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("id", key)
