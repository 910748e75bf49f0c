"""Connected components of an edge table by alternating stars, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest node of its neighbourhood.

    Each edge makes one row at most, so equal rows can wait for the next star to merge them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are linked to the smallest of them. Edges point from larger to smaller."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b) of longs; root is the smallest node of its component.

    Large and small stars alternate until nothing changes, O(log^2 n) rounds; every round is written
    to the shared folder, so a lost executor costs one round at most. Minima are combined before each
    shuffle, and joins of a hub with its many edges can be split by the adaptive planner. Self-links
    and repeated edges do no harm; an empty table has no components.
    """
    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        current = cut(_small_star(_large_star(current)))
        # Sums of whole edges, taken as exact decimals, stop changing exactly when the stars do.
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
