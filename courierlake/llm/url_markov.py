"""URL filtering by the ratio of two character language models.

Rules over hosts and paths judge some URLs. From these, variable-order Markov models of accepted and of
rejected URLs count characters after contexts of up to ``ORDER`` characters, and the length-normalised log-likelihood
difference, cut where it parts judged URLs that were held out best, judges the others. Counts are a table, one row for each distinct context and
pair, that is joined to what the URLs need of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import apart, columns, settled, small_batches

#: Longest context, weight of the next shorter context.
ORDER, STRENGTH = 5, 4.0
#: Of so many judged URLs one is held out for the threshold; distinct URLs meant for a block.
HELD, BLOCK = 5, 4_096
#: Steps of the score between -LIMIT and LIMIT, among which the threshold is sought.
STEPS, LIMIT = 2_001, 10.0
#: Fixed rules in their order: verdict and the host with the path that a URL starts with.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, with its verdict; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def hashes(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character (byte) of the URLs and each order, 64-bit hashes of its context and of both together; and
    the URL that each character is of. Contexts don't reach over the start of a URL."""
    raw = [u.encode() for u in urls]
    n = np.array([len(r) + 1 for r in raw])  # one byte behind the last stands for the end
    text = np.frombuffer(b"".join(r + b"\0" for r in raw), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(raw)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    mix = np.uint64(0x9E3779B97F4A7C15)
    contexts, pairs = np.zeros((ORDER + 1, len(text)), np.uint64), np.zeros((ORDER + 1, len(text)), np.uint64)
    h = np.full(len(text), 1469598103934665603, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER + 1):
            if k:
                before = np.where(place >= k, np.roll(text, k), np.uint64(2))  # 2: in front of the start
                h = (h ^ (before + np.uint64(k << 8))) * mix
                h ^= h >> np.uint64(31)
            both = (h ^ (text + np.uint64(77_777))) * mix
            contexts[k], pairs[k] = h, both ^ both >> np.uint64(29)
    return contexts, pairs, of


def places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where ``h`` stands in the sorted ``keys``, counted from one; zero where it doesn't."""
    at = np.searchsorted(keys, h)
    return np.where(np.append(keys, np.uint64(0))[at] == h, at + 1, 0) * (at < len(keys))


@dataclass
class UrlModel:
    """Counts of contexts and of contexts with a character, for rejected (0) and accepted (1) URLs: column ``i + 1`` counts key ``i``
    of the sorted hashes in ``keys`` (contexts, pairs), column 0 what was never seen."""

    contexts: np.ndarray
    pairs: np.ndarray
    keys: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, kind: np.ndarray, key: np.ndarray, counts: np.ndarray) -> UrlModel:
        """From rows of kind (0 context, 1 pair), hash, and counts by class."""
        keys, tables = [], []
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(key[at])]
            keys.append(key[at])
            tables.append(np.concatenate([np.zeros((2, 1)), counts[:, at]], axis=1))
        return cls(*tables, keys=tuple(keys))

    def scores(self, urls: list[str]) -> np.ndarray:
        """The log-likelihood difference by character; URLs that seem accepted score higher. An empty one has 0."""
        ctx, pair, of = hashes(urls)
        ctx, pair = places(self.keys[0], ctx), places(self.keys[1], pair)
        p = np.full((2, ctx.shape[1]), 1 / 256)
        for k in range(ORDER + 1):
            for y in (0, 1):
                p[y] = (self.pairs[y, pair[k]] + STRENGTH * p[y]) / (self.contexts[y, ctx[k]] + STRENGTH)
        n = np.bincount(of, minlength=len(urls))
        out = np.bincount(of, np.log(p[1]) - np.log(p[0]), len(urls)) / np.maximum(n, 1)
        return np.where(n > 1, out, 0.0)


def count(judged: DataFrame) -> DataFrame:
    """``(kind, key, n0, n1)``: how often each context (kind 0) and each context with a character (kind 1), by its 64-bit hash, occurs in
    rejected and accepted URLs. ``judged`` has ``url`` and ``accepted`` (0 or 1). All URLs count, so the table grows with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, ys = columns(batch, "url", "accepted")
            for y in (0, 1):
                if own := [u or "" for u, z in zip(urls, ys) if z == y]:
                    for kind, h in enumerate(hashes(own)[:2]):
                        key, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key.view(np.int64)), *(pa.array(n.astype(np.int64) * (y == z)) for z in (0, 1))], names=["kind", "key", "n0", "n1"])

    counted = judged.select("url", "accepted").mapInArrow(run, "kind bigint, key bigint, n0 bigint, n1 bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def scored(urls: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(url, score)`` of each distinct URL.

    URLs are dealt to blocks by their hash. A block asks for each of its distinct contexts and pairs once; the counts are joined to what
    the blocks ask for, so no task holds more of them than the URLs of one block have."""
    small_batches(urls.sparkSession)
    distinct = urls.select("url").where("url != ''").distinct()
    dealt = settled(distinct.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(max(1, -(-distinct.count() // block))))))

    def ask(held: pa.Table) -> pa.Table:
        keys = [np.unique(h) for h in hashes(held["url"].to_pylist())[:2]]
        kind = np.repeat([0, 1], [len(k) for k in keys])
        return pa.table({"block": np.full(len(kind), held["block"][0].as_py()), "kind": kind, "key": np.concatenate(keys).view(np.int64)})

    def answer(held: pa.Table, found: pa.Table) -> pa.Table:
        counts = np.stack([found["n0"].to_numpy(), found["n1"].to_numpy()]).astype(float)
        model = UrlModel.of(found["kind"].to_numpy(), found["key"].to_numpy().view(np.uint64), counts)
        return pa.table({"url": held["url"], "score": model.scores(held["url"].to_pylist())} if len(held) else {"url": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

    asked = dealt.groupBy("block").applyInArrow(ask, "block bigint, kind bigint, key bigint")
    known = asked.withColumn("k", apart("key")).join(counts.select("kind", apart("key").alias("k"), "n0", "n1"), ["kind", "k"]).select("block", "kind", "key", "n0", "n1")
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(answer, "url string, score double")


def threshold(found: DataFrame) -> float:
    """The step of ``score`` at which accepted URLs at or above it and rejected ones below it have the greatest shares together, the nearest to zero
    of equals; zero if a class is missing. ``found`` has ``score`` and ``accepted``."""
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * (STEPS - 1))))
    hist = np.zeros((2, STEPS))
    for r in found.groupBy("accepted", step.alias("step")).count().collect():  # two rows for a step at most
        hist[r["accepted"], r["step"]] = r["count"]
    no, yes = hist
    if not no.any() or not yes.any():
        return 0.0
    gain = np.append(0, np.cumsum(no))[:-1] / no.sum() + (yes.sum() - np.append(0, np.cumsum(yes))[:-1]) / yes.sum()
    values = np.arange(STEPS) / (STEPS - 1) * 2 * LIMIT - LIMIT
    best = np.flatnonzero(gain == gain.max())
    return float(values[best[np.abs(values[best]).argmin()]])


def judge(pages: DataFrame, rules=RULES, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``score`` and ``verdict`` of every row.

    A rule's verdict goes before that of the models. The models count the URLs that a rule judges, but for one in ``held`` by their hash,
    which set the threshold. Null URLs and those without ``://`` have an empty host
    and path, so no rule; a null URL scores zero like an empty one and, as nothing speaks against it, is
    allowed. Repeated rows are judged alike and counted each. Where rules accept nothing or reject nothing, the models can't
    tell URLs apart: all score zero and are allowed. An empty table gives an empty one. Other columns play no part.
    """
    small_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    judged = rows.where("r is not null").select("url", (F.col("r.verdict") == "allow").cast("int").alias("accepted"), (F.pmod(F.xxhash64("url", F.lit(held)), F.lit(held)) == 0).alias("aside"))
    learnt = judged.where("not aside")
    flat = rows.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))
    if learnt.select("accepted").distinct().count() == 2:
        found = settled(scored(rows, settled(count(learnt))))
        cut = threshold(judged.where("aside").join(found, "url").select("accepted", "score"))
        flat = flat.join(found, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        cut, flat = 0.0, flat.withColumn("score", F.lit(0.0))
    ok = F.col("url").isNull() | (F.col("url") == "") | (F.col("score") >= cut)
    return flat.select("page_id", "host", "path", "rule", "score", F.coalesce("by_rule", F.when(ok, "allow").otherwise("block")).alias("verdict"))
