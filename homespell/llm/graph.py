"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import store


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Here ``a > b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    ``edges`` holds columns ``a`` and ``b`` of one integer type, in any direction, repeats allowed;
    the result holds ``node`` and ``component`` (nodes that are their own component are left out).
    Each pass is written to the shared folder; the number of passes grows with the logarithm of the
    longest chain. Hubs are safe: minima combine before the shuffle and the joins are plain
    sort-merge joins, which adaptive execution splits.
    """
    current = store.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .where("a <> b").distinct(), "edges")
    while True:
        following = store.save(_small_star(_large_star(current)), "edges")
        # A star forest stays as it is: both relations are sets, so equal sizes of them and of
        # their intersection mean that nothing moved.
        state = (current.withColumn("side", F.lit(1)).unionByName(following.withColumn("side", F.lit(2)))
                 .groupBy("a", "b").agg(F.sum("side").alias("sides")).where("sides <> 3").limit(1).count())
        store.discard(current)
        current = following
        if not state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
