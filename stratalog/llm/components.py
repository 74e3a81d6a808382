"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _hook(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step. Every node's neighbours are linked to the smallest of them.

    ``upward``: neighbours larger than the node move (large star); otherwise
    the node and its smaller neighbours do (small star). The minimum is a
    grouped aggregate, merged map-side, and comes back by a join whose large
    partitions Spark can split, so that a hub is no single task's work.
    """
    if upward:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.select(F.col("b").alias("n"), F.col("a").alias("o")).groupBy("n").agg(F.min("o").alias("m"))
        moved = edges.select(F.col("b").alias("n"), F.col("a").alias("o")).join(least, "n")
        out = moved.where("o <> m").select(F.col("m").alias("a"), F.col("o").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("n").alias("b"))
        )
    return out.where("a < b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, the smallest node reachable.

    Only nodes that have an edge are returned; loops and repeated edges are
    harmless, nulls are dropped, and an empty table gives an empty result.
    Alternating large and small stars converge in a number of rounds that
    grows with the logarithm of the node count; each round is written to the
    shared folder and the one before it deleted. Only a count and a checksum reach the driver.
    """
    now = stage(
        edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
        .where("a < b")
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        last, now = now, stage(_hook(_hook(now, True), False), "stars")
        discard(last)
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
