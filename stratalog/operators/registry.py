"""The node registry as a table of operations: what each gives, who is live, what is published.

A node with very many operations is numbered by node and day; what a day hands
on to the next is one row, so that no task reads a node whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(ops: DataFrame, lease: str) -> DataFrame:
    """``ops(node_id, at, seq, op)`` with ``outcome`` and ``expires_at``.

    ``register`` always succeeds. ``renew`` is ``renewed`` up to the expiry
    itself, ``expired`` after it, which removes the registration, and
    ``missing`` without one. ``deregister`` leaves a tombstone. Operations of
    one time go by ``seq``; those without a node or a time are left out.
    """
    span = F.expr(f"INTERVAL {lease}")
    keys = ["node_id", "day"]
    near = Window.partitionBy(*keys).orderBy("at", "seq")
    days = Window.partitionBy("node_id").orderBy("day")
    rows = ops.where("node_id IS NOT NULL AND at IS NOT NULL").withColumn("day", F.to_date("at"))
    ends = rows.groupBy(*keys).agg(F.max("at").alias("end"))
    ends = ends.select(*keys, F.lag("end").over(days).alias("end_before"))
    previous = F.coalesce(F.lag("at").over(near), F.col("end_before"))
    # what does not follow on from the operation before it, in time or in kind
    fresh = (F.col("op") != "renew") | previous.isNull() | (previous + span < F.col("at"))
    rows = rows.join(ends, keys).withColumn("fresh", fresh)
    so_far = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", F.last(F.when(F.col("fresh"), F.col("op")), ignorenulls=True).over(so_far))
    handed = rows.groupBy(*keys).agg(F.max_by("head", F.struct("at", "seq")).alias("head"))
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select(*keys, F.last("head", ignorenulls=True).over(earlier).alias("carried"))
    rows = rows.withColumn("head_before", F.lag("head").over(near)).join(handed, keys)
    registered = F.coalesce("head", "carried") == "register"
    was_registered = F.coalesce(F.col("head_before"), F.col("carried")) == "register"
    outcome = (
        F.when(F.col("op") == "register", "registered")
        .when(F.col("op") == "deregister", "deregistered")
        .when(~F.col("fresh") & registered, "renewed")
        .when(F.col("fresh") & was_registered, "expired")
        .otherwise("missing")
    )
    done = rows.withColumn("outcome", outcome)
    held = F.col("outcome").isin("registered", "renewed")
    return done.withColumn("expires_at", F.when(held, F.col("at") + span)).select(*ops.columns, "outcome", "expires_at")


def live(done: DataFrame, now: Column) -> DataFrame:
    """Nodes whose last operation up to ``now`` left a registration that ends after it."""
    last = done.where(F.col("at") <= now).groupBy("node_id").agg(F.max_by("expires_at", F.struct("at", "seq")).alias("expires_at"))
    return last.where(F.col("expires_at") > now)


def published_changes(live_nodes: DataFrame, polls: DataFrame) -> DataFrame:
    """Changes between polls whose change was taken; ``polls(poll_at, delivered)``.

    What an untaken poll saw is forgotten: the next one compares with the nodes
    of the last that was taken. Polls are one a day and numbered in one task.
    """
    taken = polls.where("delivered").select("poll_at").distinct()
    taken = taken.withColumn("no", F.row_number().over(Window.orderBy("poll_at")))
    now = live_nodes.join(taken, "poll_at").select("no", "node_id")
    before = now.select((F.col("no") + 1).alias("no"), "node_id").alias("b")
    now = now.alias("n")
    same = (F.col("n.no") == F.col("b.no")) & (F.col("n.node_id") == F.col("b.node_id"))
    changed = now.join(before, same, "full_outer").where(F.col("n.no").isNull() | F.col("b.no").isNull())
    named = changed.select(
        F.coalesce("n.no", "b.no").alias("no"),
        F.coalesce("n.node_id", "b.node_id").alias("node_id"),
        F.when(F.col("b.no").isNull(), "registered").otherwise("deregistered").alias("change"),
    )
    return named.join(taken, "no").select("poll_at", "node_id", "change")
