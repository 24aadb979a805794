"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import materialise

ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over (a, b), a > b. Only the least neighbour of a node is joined
    back, so a hub's links arrive as partial minima and its join can be split."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(smallest, "a")
    moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b), except roots: root is the smallest node reachable.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == mark or seen.n == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, now = seen, materialise(_stars(now), "links")
    raise RuntimeError("components did not settle")
