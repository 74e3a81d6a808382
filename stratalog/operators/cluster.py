"""Membership: leases from heartbeats, live nodes, and changes between polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heartbeats(rows: DataFrame, lease: str) -> DataFrame:
    """``rows(node_id, ts, …)`` with ``expires_at``; ``lease`` as in ``6 HOURS``."""
    return rows.withColumn("expires_at", F.col("ts") + F.expr(f"INTERVAL {lease}"))


def live_nodes(beats: DataFrame, now: Column) -> DataFrame:
    """Nodes whose newest lease, as known at ``now``, ends after ``now``."""
    newest = beats.where(F.col("ts") <= now).groupBy("node_id").agg(F.max("expires_at").alias("expires_at"))
    return newest.where(F.col("expires_at") > now)


def leases(beats: DataFrame, order: list[str]) -> DataFrame:
    """Leases of each node: a heartbeat at or before the expiry renews, a later one registers anew.

    Heartbeats are first folded by node and day, so that a node with very many
    is the work of one task a day; what a node's days give is then joined up.
    """
    chunk = F.to_date("ts")
    near = Window.partitionBy("node_id", "chunk").orderBy(*order)
    gap = F.when(F.lag("expires_at").over(near) >= F.col("ts"), 0).otherwise(1)
    runs = (
        beats.withColumn("chunk", chunk)
        .withColumn("gap", gap)
        .withColumn("run", F.sum("gap").over(near.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("node_id", "chunk", "run")
        .agg(F.min("ts").alias("registered_at"), F.max("expires_at").alias("expired_at"), F.count("*").alias("renewals"))
    )
    whole = Window.partitionBy("node_id").orderBy("registered_at", "run")
    fresh = F.when(F.lag("expired_at").over(whole) >= F.col("registered_at"), 0).otherwise(1)
    return (
        runs.withColumn("fresh", fresh)
        .withColumn("lease_no", F.sum("fresh").over(whole.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
        .groupBy("node_id", "lease_no")
        .agg(
            F.min("registered_at").alias("registered_at"),
            F.max("expired_at").alias("expired_at"),
            F.sum("renewals").alias("renewals"),
        )
    )


def live_at_polls(beats: DataFrame, polls: DataFrame) -> DataFrame:
    """``(poll_at, node_id)`` for daily polls: each heartbeat names the polls in its lease.

    A heartbeat's polls follow from its own times, so that there is no join of
    all heartbeats with all polls.
    """
    day = F.expr("INTERVAL 1 DAY")
    midnight = F.date_trunc("day", "ts").cast("timestamp_ntz")
    first = F.when(midnight == F.col("ts"), midnight).otherwise(midnight + day)
    named = (
        beats.withColumn("first", first)
        .where(F.col("first") < F.col("expires_at"))
        .select("node_id", "expires_at", F.explode(F.sequence("first", "expires_at", day)).alias("poll_at"))
        .where(F.col("poll_at") < F.col("expires_at"))
        .select("poll_at", "node_id")
        .distinct()
    )
    return named.join(F.broadcast(polls) if _few_days(polls) else polls, "poll_at", "left_semi")


def _few_days(polls: DataFrame, most: int = 100_000) -> bool:
    return polls.limit(most + 1).count() <= most


def membership_changes(live: DataFrame, polls: DataFrame) -> DataFrame:
    """Nodes that came or went between consecutive daily polls, by id alone.

    All nodes of the first poll are new; nothing is said after the last poll.
    """
    end = polls.agg(F.max("poll_at").alias("end"))
    now = live.alias("c")
    before = live.select((F.col("poll_at") + F.expr("INTERVAL 1 DAY")).alias("poll_at"), "node_id").alias("n")
    same = (F.col("c.poll_at") == F.col("n.poll_at")) & (F.col("c.node_id") == F.col("n.node_id"))
    return (
        now.join(before, same, "full_outer")
        .where(F.col("c.node_id").isNull() | F.col("n.node_id").isNull())
        .select(
            F.coalesce("c.poll_at", "n.poll_at").alias("poll_at"),
            F.coalesce("c.node_id", "n.node_id").alias("node_id"),
            F.when(F.col("n.node_id").isNull(), "registered").otherwise("deregistered").alias("change"),
        )
        .join(F.broadcast(end), F.col("poll_at") <= F.col("end"))  # one row
        .drop("end")
    )
