"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlwatch.operators.frames import gathered, settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of its neighbourhood; ``n`` edges at most, before and after."""
    near = _both_ways(edges)
    least = gathered(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * n)
    tied = gathered(near.where(F.col("b") > F.col("a")).join(least, "a"), n)
    return gathered(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them; ``n`` edges at most, before and after."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = gathered(down.groupBy("a").agg(F.min("b").alias("m")), n)
    tied = gathered(down.join(least, "a"), n).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return gathered(tied.union(least.select("a", F.col("m").alias("b"))).distinct(), n)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component; roots are left out.

    Links from a node to itself and nulls don't count. Each round is settled; the number of rounds grows with the logarithm
    of a component's size, and sums over neighbours are taken within tasks first, so that a node with very many
    neighbours is no hot group. Tasks are as many as the links need, from the start where the caller knows that there are ``most`` of them.
    """
    now = edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    now = settled(now if most is None else gathered(now, most))
    n = now.count()
    now = gathered(now, n)
    state = None
    while True:
        now = settled(_small_star(_large_star(now, n), n))
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(row)
