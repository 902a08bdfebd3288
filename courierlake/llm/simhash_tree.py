"""SimHash near-duplicates through vantage-point trees.

Texts become 64-bit fingerprints. A tree of vantage points, built on a bounded sample, deals the distinct
fingerprints to shards: at each node those within ``cut`` bits of the vantage point go inside, the others
outside. Two fingerprints that differ in ``radius`` bits or less have distances to the vantage point that
differ by that much or less (the triangle bound), so it is enough that what lies up to ``cut + radius``
visits the inside shard too: any close pair then meets in a shard. Inside a shard the same splitting goes
on in memory down to leaves, where all pairs are compared. Shards return spanning links, never all pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import WORD, among, apart, columns, pack, ranges, settled, small_batches, tidied, unpack, unsized, whole_groups
from .words import mixed_bits, run_hashes, word_hashes

#: Fingerprints on which the tree is built, and the number meant for a shard.
SAMPLE, SHARD = 20_000, 1_024
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
LEAF = 128
#: Near copies of the pipeline: words in a shingle, the least similarity of shingle sets, 64-bit words of a fingerprint, and the bits in which
#: those of candidates may differ: of pairs just at that similarity 99.9 % or more differ in no more.
COPY_SHINGLE, COPY_SIMILARITY, WIDE, COPY_RADIUS = 5, 0.8, 16, 190
#: Bands by which near copies meet, and the least hashes in a band: of pairs just at that similarity 99.98 % share a band.
BANDS, ROWS = 16, 4
#: Units of a shard that are compared in a group, from each of two blocks.
BLOCK = 512
#: Documents whose shingles are counted so that frequent ones come last in a set, shingles that are known to be frequent, and bits of a parity.
COUNTED, FREQUENT, PARITY = 8_192, 1 << 16, 1_024
#: Bits of a rare shingle that go to a bucket, shingles meant for a bucket, and pairs of units that are compared at once.
BITS, BUCKET, PAIRS = 48, 1 << 20, 1 << 17
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_words = re.compile(WORD)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer: a bit is set if it is in over half of the XXH64
    (seed 42) of its word shingles, repeats included. Fewer words than a shingle make one shingle; no
    word makes zero."""
    words = _words.findall(text.translate(UPPER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        if len(part) < shingle:
            part = [" ".join(part)]
        else:
            part = [" ".join(x) for x in zip(*(part[i:] for i in range(shingle)))]
        h = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in part], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_id, fp long)`` of each row; a null text counts as empty, and ``text_id`` is the xxHash of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t or "", shingle) for t in texts], pa.int64())], names=["doc_id", "text_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), "text").mapInArrow(run, "doc_id bigint, text_id bigint, fp bigint")


def distances(fps: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(vantage)).astype(np.int16)


def best_split(fps: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6) -> tuple[int, int] | None:
    """The vantage point and cut that leave the least to compare: squares of both sides, visitors included.
    None if no cut leaves less than the whole."""
    best, least = None, 0.9 * len(fps) ** 2
    for v in rng.choice(fps, min(tries, len(fps)), replace=False):
        upto = np.cumsum(np.bincount(distances(fps, v), minlength=65 + radius))
        inside, outside = upto[radius : 65 + radius].astype(float), len(fps) - upto[:65]
        cost = inside**2 + outside.astype(float) ** 2
        cost[(upto[:65] == 0) | (outside == 0)] = np.inf
        if cost.min() < least:
            best, least = (int(v), int(cost.argmin())), cost.min()
    return best


def build_tree(sample: np.ndarray, scale: float, shard: int, radius: int) -> tuple[list, int]:
    """Nodes ``(vantage, cut, inside, outside)``, the root first, where a negative child ``-s - 1`` is shard
    ``s``; and the number of shards. ``scale`` is the number of fingerprints for each in the sample."""
    rng, nodes, shards = np.random.default_rng(7), [], 0

    def grow(fps: np.ndarray) -> int:
        nonlocal shards
        split = best_split(fps, radius, rng) if len(fps) * scale > shard and len(fps) >= 16 else None
        if split is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        d = distances(fps, split[0])
        nodes[at] = (*split, grow(fps[d <= split[1] + radius]), grow(fps[d > split[1]]))
        return at

    grow(sample)
    return nodes, shards


def route(nodes: list, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``fps`` and the shards they go to, visitors included."""
    rows, shards, stack = [], [], [(0 if nodes else -1, np.arange(len(fps)))]
    while stack:
        node, who = stack.pop()
        if node < 0:
            rows.append(who)
            shards.append(np.full(len(who), -node - 1))
        elif len(who):
            v, cut, inside, outside = nodes[node]
            d = distances(fps[who], v)
            stack += [(inside, who[d <= cut + radius]), (outside, who[d > cut])]
    return np.concatenate(rows), np.concatenate(shards)


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect those of the distinct ``fps`` that chains of close pairs connect: at most one for
    each leaf it is in, to the first of its component there."""
    rng, stack, left, right = np.random.default_rng(11), [np.arange(len(fps))], [], []
    while stack:
        who = stack.pop()
        split = best_split(fps[who], radius, rng, 3) if len(who) > LEAF else None
        if split is not None:
            d = distances(fps[who], split[0])
            stack += [who[d <= split[1] + radius], who[d > split[1]]]
            continue
        label = np.arange(len(who))
        while True:  # labels sink to the least of what is close; blocks bound the memory of leaves without a cut
            before = label.copy()
            for i in range(0, len(who), LEAF):
                close = np.bitwise_count(fps[who[i : i + LEAF], None] ^ fps[None, who]) <= radius
                label[i : i + LEAF] = np.where(close, label[None, :], len(who)).min(axis=1)
            label = label[label]
            if (label == before).all():
                break
        tied = np.flatnonzero(label != np.arange(len(who)))
        left.append(who[tied])
        right.append(who[label[tied]])
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Components of documents whose fingerprints differ in ``radius`` bits or less.

    Returns a row for each row of ``docs``: ``doc_id``, ``text_id``, ``fp`` (signed 64-bit), ``group_id`` (equal within a component) and ``component_id``, the
    smallest ``doc_id`` reachable through close fingerprints, itself included.

    Null and empty texts have the fingerprint zero and are linked like any other. A null ``doc_id`` takes
    part in links, but never is the smallest; a component without any id gets null. Rows with equal ids
    are told apart by their fingerprints alone. An empty table gives an empty one. Other columns play no
    part. The tree is fitted on at most about ``sample`` of the distinct fingerprints, chosen by their
    hash; every fingerprint is dealt and compared.
    """
    spark = docs.sparkSession
    rows = settled(fingerprints(docs, shingle))
    distinct = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    n = distinct.count()
    if not n:
        return rows.select("*", F.lit(None).cast("long").alias("group_id"), F.lit(None).cast("long").alias("component_id"))
    one_in = -(-n // sample)
    seen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).select("fp").toPandas()["fp"].to_numpy(np.int64)
    nodes, shards = build_tree(seen.view(np.uint64), n / max(1, len(seen)), shard, radius)
    sent = spark.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            who, to = route(sent.value, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[who]), pa.array(to, pa.int64())], names=["fp", "shard"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        a, b = spanning_links(fps, radius)
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    links = distinct.select("fp").mapInArrow(deal, "fp bigint, shard bigint").groupBy("shard").applyInPandas(compare, "a bigint, b bigint")
    of = connected_components(links)
    joined = distinct.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    ids = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.withColumn("k", apart("component")).join(ids.select(apart("component").alias("k"), "component_id"), "k").select("fp", F.col("component").alias("group_id"), "component_id")
    return rows.join(named, "fp").select("doc_id", "text_id", "fp", "group_id", "component_id")


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles. Fewer words than a shingle make one; no word makes none."""
    h, at = word_hashes(texts)
    s, out = run_hashes(h, shingle), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        few = h[a:b]
        if 0 < b - a < shingle:
            few = np.append(few, np.full(shingle - len(few), len(few), np.uint64))  # as if numbers stood behind
            out.append(run_hashes(few, shingle))
        else:
            out.append(np.unique(s[a : max(a, b - shingle + 1)]))
    return out


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> np.ndarray:
    """The SimHash of distinct shingles in ``words`` times 64 bits: a bit is set if it is in over half of them."""
    bits, salts = np.zeros(words * 64, np.int64), np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), CHUNK >> 4):
        h = mixed_bits(hashes[at : at + (CHUNK >> 4), None] + salts)
        bits += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each set and band, of the band's number and the set's least hashes under ``rows`` permutations."""
    factors = np.random.default_rng(29).integers(0, 1 << 63, (bands * rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    filled = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
    starts = np.cumsum([0, *(len(x) for x in filled)])[:-1]
    h, out = np.concatenate(filled), np.zeros((len(sets), bands), np.uint64)
    for i, (a, b) in enumerate(factors):
        least = np.minimum.reduceat(h * a ^ (h >> np.uint64(32)) * b, starts)
        out[:, i // rows] = mixed_bits(out[:, i // rows] ^ least) + np.uint64(i)
    return out.view(np.int64)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def rare_first(hashes: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the sorted ``hashes`` by how often they were counted and then by value, as many as it takes: two sets of this similarity have one
    of them in common, as all but so many of either are too few."""
    least = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.argsort(times, kind="stable")[:least]] if times.any() else hashes[:least]


def parity(hashes: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Whether an odd number of the hashes falls on each of ``bits`` places, or of a power of two more for long sets. Sets differ in as many hashes as
    their parities do, or more."""
    while bits < 2 * len(hashes):
        bits *= 2
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little")


def folded(marks: bytes, size: int) -> np.ndarray:
    """A parity of ``size`` bytes from one of more, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(marks, "<u8").reshape(-1, size // 8), axis=0)


def most_apart(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """In how many elements sets of ``a`` and ``b`` elements differ at most if they have the similarity."""
    return (a + b) * (1 - similarity) / (1 + similarity) + 1e-6


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``COUNTED`` texts hold, and how many times as powers of two. Only the order of work depends on them."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    one_in = max(1, docs.count() // COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0), shingle)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    o = np.argsort(h)
    return h[o], np.log2(n[o]).astype(np.int8)


def _sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(doc_id, text_id, key, n, bands, rare, parity)`` of each row, where equal shingle sets have equal keys."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            if batch.num_rows:
                sets, rare = shingle_sets(batch.column(2), shingle), []
                for s in sets:
                    times, due = np.zeros(len(s), np.int8), np.flatnonzero(maybe[s >> np.uint64(44)])
                    if len(due):
                        at = np.minimum(np.searchsorted(known, s[due]), len(known) - 1)
                        times[due] = np.where(known[at] == s[due], often[at], np.int8(0))
                    rare.append(rare_first(s, times, similarity).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(band_keys(sets)), pa.list_(pa.int64())),
                     pa.array(rare, pa.list_(pa.int64())), pa.array([parity(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "text_id", "key", "n", "bands", "rare", "parity"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, text_id bigint, key bigint, n bigint, bands array<bigint>, rare array<bigint>, parity binary")


def _whole_sets(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``(key, fp, hashes)`` for the rows of ``docs`` that ``rows`` names by id and text: the wide fingerprint and the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few texts at a time, as the hashes of long ones are many
                sets = shingle_sets(batch.column(0).slice(at, 64), shingle)
                fps = pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), fps, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "fp", "hashes"])

    no_id = lambda c: F.coalesce(c, F.lit(-(2**63)))
    texts = docs.select(no_id(F.col("doc_id").cast("long")).alias("doc_id"), F.xxhash64("text").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = among(texts, rows.select(no_id(F.col("doc_id")).alias("doc_id"), "text_id").distinct(), "doc_id", "text_id")
    return wanted.select("text").mapInArrow(run, "key bigint, fp binary, hashes array<bigint>").dropDuplicates(["key"])


def nearest_to_middle(fps: np.ndarray) -> int:
    """The row of ``fps`` that differs least from the majority of all in each bit."""
    middle = np.packbits(np.unpackbits(fps.view(np.uint8), axis=1).mean(axis=0) > 0.5).view("<u8")
    return int(np.bitwise_count(fps ^ middle).sum(axis=1).argmin())


def close_pairs(fps: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group whose fingerprints differ in ``radius`` bits or less, whose sizes allow the similarity, and whose components (and,
    where there are two, blocks) differ."""
    two, left, right = block.min() != block.max(), [np.zeros(0, int)], [np.zeros(0, int)]
    for i in range(len(fps) - 1):
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]))) + i + 1
        j = j[block[j] != block[i]] if two else j
        j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1) <= radius]
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each group of batches that are sorted by their first ``keys`` columns."""
    for piece in whole_groups(batches, keys):
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in piece[:keys]], axis=0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(piece[0])]):
            yield [x[a:b] for x in piece]


def _pairs_of(found: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 8192) -> Iterator[pa.RecordBatch]:
    """Batches of ``(a, b)`` with the smaller key first."""
    held, size = [], 0
    for a, b in found:
        held.append((np.minimum(a, b), np.maximum(a, b)))
        size += len(a)
        if size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in (0, 1)], names=["a", "b"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in (0, 1)], names=["a", "b"])


def _stars(met: DataFrame) -> DataFrame:
    """In each block of a band, each unit with the one nearest to the middle, and whether that is itself: ``(band, a, b)``, ``a`` the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, _, key, fp in _groups(batches, 2):
            middle = nearest_to_middle(np.frombuffer(b"".join(fp), "<u8").reshape(len(fp), -1))
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.full(len(key), key[middle])), pa.array(key)], names=["band", "a", "b"])

    return met.repartition("band", "block").sortWithinPartitions("band", "block", "key").select("band", "block", "key", "fp").mapInArrow(run, "band bigint, a bigint, b bigint")


def _between(met: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs of keys ``(a, b)`` of different components that share a band and may be similar, each from the first band that it shares.
    Blocks of a band are dealt to pairs of blocks."""
    mixed = met.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    held = met.withColumn("k", apart("band")).join(mixed.select(apart("band").alias("k")), "k")
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "fp", "n", "comp", "block", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for band, _, _, key, fp, n, comp, block, bands in _groups(batches, 3):
                i, j = close_pairs(np.frombuffer(b"".join(fp), "<u8").reshape(len(fp), -1), n, comp, block, radius, similarity)
                if len(i):
                    of = np.stack(bands)
                    shared = of[i] == of[j]
                    first = of[i, shared.argmax(axis=1)] == band[0]
                    yield key[i[first]], key[j[first]]

        yield from _pairs_of(found())

    grouped = dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "key")
    return grouped.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose shingle sets have a Jaccard similarity of ``similarity`` or more, by whole sets."""
    a, b = (sets.select(apart("key").alias(f"k{x}"), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = pairs.select(apart("a").alias("ka"), apart("b").alias("kb"), "a", "b").join(a, "ka").join(b, "kb")
    same = F.size(F.array_intersect("ha", "hb"))
    return both.where(same >= F.lit(similarity) * (F.size("ha") + F.size("hb") - same)).select("a", "b")


def _rest(units: DataFrame, similarity: float, block: int, bucket: int = BUCKET) -> DataFrame:
    """Pairs of keys ``(a, b)`` of different components of ``units`` (``key``, ``n``, ``comp``, ``rare``, ``parity``) that may be similar. No such pair is left out: both hold one of their
    rare shingles, their sizes allow the similarity, and so do their parities. Shingles go packed to buckets, only those that units of different
    components hold come out again, and those of many are dealt to pairs of blocks."""
    buckets = -(-max(1, units.agg(F.sum(F.size("rare"))).first()[0] or 0) // bucket)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            shingle, key, n, comp = (np.concatenate([h[i] for h in held]) for i in range(4))
            to, shingle = (shingle % np.uint64(buckets)).astype(np.int64), shingle // np.uint64(buckets)
            o, out = np.lexsort((shingle, to)), []
            for part in np.split(o, np.flatnonzero(np.diff(to[o])) + 1):
                steps = np.diff(shingle[part], prepend=np.uint64(0))
                out.append((int(to[part[0]]), pack(steps, n[part], key[part].view(np.uint64), (comp[part] ^ key[part]).view(np.uint64))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.binary()))], names=["bucket", "packed"])

        for batch in batches:
            key, n, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rare = batch.column(3)
            size = np.diff(rare.offsets.to_numpy())
            shingle = rare.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append([shingle >> np.uint64(64 - BITS), *(np.repeat(x, size) for x in (key, n, comp))])  # fewer bits only bring more candidates
            if sum(len(h[0]) for h in held) >= bucket:
                yield rows()
                held = []
        if sum(len(h[0]) for h in held):
            yield rows()

    def alive(held: pa.Table) -> pa.Table:
        """The units that share a shingle with one of another component whose size allows the similarity, and their block."""
        parts = [unpack(data, 4) for data in held["packed"].to_pylist()]
        shingle, n, key, comp = (np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(4))
        o = np.lexsort((n, shingle))
        same = shingle[o][1:] == shingle[o][:-1]
        o = o[np.append(same, False) | np.append(False, same)]  # what one unit alone holds goes
        shingle, n, key, comp = shingle[o], n[o].astype(np.int64), key[o], comp[o] ^ key[o]
        number = np.cumsum(np.append(0, shingle[1:] != shingle[:-1])[: len(o)]).astype(np.int64) << 33
        at, change = number + n, np.cumsum(np.append(0, comp[1:] != comp[:-1])[: len(o)])
        low = np.searchsorted(at, number + np.ceil(similarity * n - 1e-6).astype(np.int64))
        high = np.searchsorted(at, number + np.floor(n / similarity + 1e-6).astype(np.int64), side="right") - 1
        stay = np.flatnonzero(change[high] > change[low])
        number = number[stay] >> 33
        size = np.bincount(number, minlength=1)[number] if len(stay) else number
        parts = -(-size // block)
        own = (key[stay] % parts.astype(np.uint64)).astype(np.int32) if len(stay) else number.astype(np.int32)
        bucket_of = np.full(len(stay), held["bucket"][0].as_py())
        return pa.table([pa.array(x) for x in (bucket_of, shingle[stay].view(np.int64), key[stay].view(np.int64), parts.astype(np.int32), own)], names=["bucket", "shingle", "key", "parts", "block"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for *group, key, marks, n, comp, own in whole_groups(batches, 4):
                bits = np.stack([folded(x, PARITY // 8) for x in marks])
                new = np.append(True, np.any([x[1:] != x[:-1] for x in group], axis=0))
                end, rows, inner = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1], np.arange(len(key)), group[2] == group[3]
                for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(end - rows - 1) // PAIRS)) + 1):
                    j, i = ranges(part + 1, end[part] - part - 1)
                    i = part[i]
                    due = (comp[i] != comp[j]) & (inner[i] | (own[i] != own[j])) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
                    i, j = i[due], j[due]
                    most = most_apart(n[i], n[j], similarity)
                    near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= most
                    pairs = {}
                    for x, y, z in zip(i[near].tolist(), j[near].tolist(), most[near].tolist()):
                        pair, size = (min(key[x], key[y]), max(key[x], key[y])), min(len(marks[x]), len(marks[y]))
                        if pair not in pairs:
                            pairs[pair] = size * 8 == PARITY or np.bitwise_count(folded(marks[x], size) ^ folded(marks[y], size)).sum() <= z
                    pairs = np.array([pair for pair, fine in pairs.items() if fine], np.int64).reshape(-1, 2)
                    if len(pairs):
                        yield pairs[:, 0], pairs[:, 1]

        yield from _pairs_of(found())

    sent = units.select("key", "n", "comp", "rare").mapInArrow(send, "bucket bigint, packed binary")
    shared = settled(sent.groupBy("bucket").applyInArrow(alive, "bucket bigint, shingle bigint, key bigint, parts int, block int"))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", "shingle", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "block")
    whole = among(units.select("key", "parity", "n", "comp"), shared.select("key").distinct(), "key")
    work = ["bucket", "shingle", "lo", "hi"]
    dealt = unsized(dealt.withColumn("k", apart("key"))).join(whole.select(apart("key").alias("k"), "parity", "n", "comp"), "k").select(*work, "key", "parity", "n", "comp", "block")
    return dealt.repartition(*work).sortWithinPartitions(*work).mapInArrow(compared, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, radius: int = COPY_RADIUS, shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Returns ``doc_id``, ``text_id`` (xxHash of the text), ``group_id`` (equal within a component) and ``component_id``, the smallest ``doc_id`` reachable, for each row of ``docs``.

    At that similarity fingerprints of 64 bits differ in so many that the triangle bound of a vantage point lets
    nothing be pruned. So units (distinct shingle sets) are dealt to shards by bands of their least hashes, those of a shard whose fingerprints
    (of ``64 * WIDE`` bits) differ in ``radius`` bits or less are candidates, and each is verified by the whole shingle sets before it links. First
    each unit tries the one nearest to the middle of each of its shards; then all candidates between the components found are tried, so that only
    pairs that are linked already are saved. Shards are cut into blocks of ``block`` units, whose middles are tried among themselves. Bands and fingerprints
    may miss pairs, above all of short texts, so last of all every pair of different components that could be similar by its rarest shingles, sizes and parities is
    verified (``_rest``): no link between components is left out. Null and
    empty texts are equal. A null ``doc_id`` takes part in links, but never is the smallest. Rows are told apart by id and text. An empty
    table gives an empty one. Other columns play no part.
    """
    with tidied(docs.sparkSession):
        return settled(_near_copies(docs, radius, shingle, similarity, block))


def _near_copies(docs: DataFrame, radius: int, shingle: int, similarity: float, block: int) -> DataFrame:
    rows = settled(_sets(docs, shingle, similarity))
    marks = "bands", "rare", "parity"
    units = settled(rows.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("text_id", "doc_id")).alias("row"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in marks)))
    spread = units.select(F.explode("bands").alias("band"), "key")
    parts = F.ceil(F.count("*") / block).cast("int").alias("parts")
    shards = spread.groupBy("band").agg(parts, F.count("*").alias("units")).where("units > 1").select(apart("band").alias("k"), "parts")
    met = settled(spread.withColumn("k", apart("band")).join(unsized(shards), "k").select("band", "key", "parts", F.pmod("key", "parts").cast("int").alias("block")))
    inside = met.select("key").distinct()
    sets = settled(_whole_sets(docs, units.join(inside, "key").select("row.*"), shingle))
    marked = met.join(sets.select("key", "fp"), "key")
    stars = settled(_stars(marked))
    middles = stars.where("a = b").join(met.where("parts > 1").select("band", F.col("key").alias("a")), ["band", "a"]).select("band", F.lit(0).alias("block"), F.col("a").alias("key"))
    again = _stars(middles.join(sets.select("key", "fp"), "key"))
    pairs = settled(stars.union(again).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def named(links: DataFrame, of: DataFrame) -> DataFrame:
        """``of`` with the components that the links join, whose ends are components of ``of``."""
        tied = connected_components(links).withColumnRenamed("node", "comp")
        return of.join(tied, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")

    def further(found: DataFrame, of: DataFrame) -> DataFrame:
        """``of`` with the components that the pairs of keys in ``found`` join."""
        at = {x: of.select(apart("key").alias(f"k{x}"), F.col("comp").alias(f"c{x}")) for x in "ab"}
        links = found.select(apart("a").alias("ka"), apart("b").alias("kb")).join(at["a"], "ka").join(at["b"], "kb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        return settled(named(settled(links), of))

    linked = settled(named(settled(_verified(pairs, sets, similarity)), units.drop("rare", "parity").withColumn("comp", F.col("key"))))
    whole = linked.select("key", "n", "comp", "bands").join(sets.select("key", "fp"), "key")
    tried = settled(_between(met.join(whole, "key"), radius, similarity).join(pairs, ["a", "b"], "left_anti"))
    linked = further(_verified(tried, sets, similarity), linked.drop("bands"))
    whole = linked.select("key", "comp").join(units.select("key", "n", "rare", "parity"), "key")
    rest = settled(_rest(whole, similarity, block).join(tried.union(pairs), ["a", "b"], "left_anti"))
    asked = rest.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    joined = further(_verified(rest, settled(_whole_sets(docs, units.join(asked, "key").select("row.*"), shingle)), similarity), linked)
    ids = joined.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of = joined.withColumn("k", apart("comp")).join(ids.select(apart("comp").alias("k"), "component_id"), "k").select(apart("key").alias("k"), F.col("comp").alias("group_id"), "component_id")
    return rows.withColumn("k", apart("key")).join(of, "k").select("doc_id", "text_id", "group_id", "component_id")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` of which one stays for each component of ``found``: that of the smallest id, of several texts with that id the one
    with the smallest ``text_id``. Repeated rows of an id and text count as one. Rows without an id stay. An empty table stays empty, and columns may be called like those of ``found``."""
    stay = found.where("doc_id = component_id").groupBy("group_id").agg(F.min("text_id").alias("__text"), F.min("doc_id").alias("__id"))
    named = docs.where("doc_id is not null").withColumns({"__id": F.col("doc_id").cast("long"), "__text": F.xxhash64("text")})
    kept = named.join(stay, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))
