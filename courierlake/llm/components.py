"""Connected components by alternating large-star and small-star rounds.

Every round is an aggregation (whose partial sums absorb hubs) and an equi-join (whose hot keys adaptive
execution splits). No adjacency list is ever gathered in a row, a task or the driver. A round's edges are written to the
shared folder and read again: a checkpoint would carry the estimated size on, to its fourth power in each round,
and such numbers come to fill the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlake.session import remove

from .shared import apart, new_dir, settled, unsized


def _large(edges: DataFrame) -> DataFrame:
    """Each node passes its least neighbour to its larger neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    pairs = both.where("b > a").select(apart("a").alias("k"), "b")
    return pairs.join(unsized(least.select(apart("a").alias("k"), "m")), "k").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. Edges run from a larger a to b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.select(apart("a").alias("k"), "b").join(unsized(least.select(apart("a").alias("k"), "m")), "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).where("a > b")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of the edge table ``(a long, b long)``.

    ``component`` is the least node reachable. Loops, repeated edges and edges with a null end are
    ignored, so a node without any other edge isn't returned; an empty table gives an empty one.
    ``rounds`` only guards against endless work: rounds grow with the logarithm of the node count and
    the call raises if they don't suffice.
    """
    spark, last, said = edges.sparkSession, None, None

    def written(df: DataFrame) -> DataFrame:
        nonlocal last
        df.write.parquet(path := new_dir(spark, "edges"))
        if last:
            remove(spark, last)
        last = path
        return spark.read.schema("a long, b long").parquet(path)

    now = written(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b").distinct())
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if tuple(mark) == said or not mark[0]:
            found = settled(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()))
            remove(spark, last)
            return found
        said = tuple(mark)
        now = written(_small(_large(now).where("a > b").distinct()).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
