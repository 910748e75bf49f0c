"""Bounded walks over an edge list, for many start nodes at once.

Every hop is one equi-join of the frontier with the edges, made distinct before it is compared with
what has been visited. Each hop is written to the shared folder, so the plan of a later hop starts
from files and a lost executor costs one hop at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.topk import top_k
from codequarry.session import cut


def reach(edges: DataFrame, seeds: DataFrame, depth: int, include_seeds: bool = False) -> DataFrame:
    """seeds(request_id, node) to every node within `depth` hops with its nearest depth."""
    edges = cut(edges.select("src", "dst").distinct())
    visited = cut(seeds.select("request_id", "node").distinct().withColumn("depth", F.lit(0)))
    frontier, layers = visited, [visited]
    for hop in range(1, depth + 1):
        reached = frontier.select("request_id", F.col("node").alias("src")).join(edges, "src")
        fresh = reached.select("request_id", F.col("dst").alias("node")).distinct()
        for layer in layers:
            fresh = fresh.join(layer.select("request_id", "node"), ["request_id", "node"], "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        layers.append(frontier)
    result = layers[0]
    for layer in layers[1:]:
        result = result.unionByName(layer)
    return result if include_seeds else result.filter("depth > 0")


def nearest(edges: DataFrame | Callable[[int, DataFrame], DataFrame], seeds: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """First `max_nodes` nodes per request in queue order: depth, parent's place, edge order.

    edges(src, dst, ord), or a function of the hop and its start nodes that gives at least theirs;
    seeds(request_id, node, ord). Only nodes that made the cut are expanded, which is what a queue
    stopped at `max_nodes` does, so a frontier never exceeds it.
    """
    first = seeds.groupBy("request_id", "node").agg(F.min("ord").alias("ord"))
    chosen = cut(
        top_k(first, ["request_id"], [F.col("ord"), F.col("node")], max_nodes, "place").withColumn(
            "depth", F.lit(0)
        ).select("request_id", "node", "depth", "place")
    )
    frontier = chosen
    for hop in range(1, depth + 1):
        outgoing = edges(hop, frontier) if callable(edges) else edges
        reached = frontier.select("request_id", F.col("node").alias("src"), "place").join(outgoing, "src")
        fresh = reached.groupBy("request_id", F.col("dst").alias("node")).agg(
            F.min(F.struct("place", "ord", "dst")).alias("key")
        ).join(chosen.select("request_id", "node"), ["request_id", "node"], "left_anti")
        taken = chosen.groupBy("request_id").agg(F.count("*").alias("taken"))
        placed = top_k(fresh, ["request_id"], [F.col("key")], max_nodes, "_n").join(taken, "request_id")
        frontier = cut(
            placed.withColumn("place", F.col("_n") + F.col("taken")).filter(F.col("place") <= max_nodes).select(
                "request_id", "node", F.lit(hop).alias("depth"), "place"
            )
        )
        if frontier.isEmpty():
            break
        chosen = cut(chosen.unionByName(frontier))
    return chosen


def chains(edges: DataFrame, seeds: DataFrame, steps: int, order: list[Column], fan_out: int) -> DataFrame:
    """Call chains of up to `steps` hops, following at most `fan_out` edges per node, no cycles.

    The edges of a node are cut to `fan_out` before any join.
    """
    heads = top_k(edges, ["src"], order, fan_out, "_n").select("src", "dst")
    paths = seeds.select("request_id", F.array("node").alias("path"))
    result = None
    for _ in range(steps):
        ends = paths.withColumn("src", F.element_at("path", -1)).join(heads, "src")
        paths = cut(
            ends.filter(~F.array_contains("path", F.col("dst"))).select(
                "request_id", F.concat("path", F.array("dst")).alias("path")
            )
        )
        result = paths if result is None else result.unionByName(paths)
    return result
