"""Signals, latches, topics, state machines and ordered sets over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced_signals(events: DataFrame, key: str, kind: str, order: list[str], signal: str, read: str) -> DataFrame:
    """Reads that found a signal, and signals that fell on one not yet read."""
    w = Window.partitionBy(key).orderBy(*order)
    prev = events.where(F.col(kind).isin(signal, read)).withColumn("prev", F.lag(kind).over(w))
    after_signal = F.coalesce(F.col("prev") == signal, F.lit(False))
    return prev.groupBy(key).agg(
        F.count_if((F.col(kind) == read) & after_signal).alias("reads_ok"),
        F.count_if((F.col(kind) == signal) & after_signal).alias("coalesced"),
    )


def latched_reads(events: DataFrame, key: str, kind: str, ts: str, latch: str, read: str) -> DataFrame:
    """Reads at or after the first time that a key's latch was set."""
    latched = events.where(F.col(kind) == latch).groupBy(key).agg(F.min(ts).alias("latched_at"))
    reads = events.where(F.col(kind) == read).join(latched, key, "left")
    return reads.groupBy(key).agg(F.count_if(F.coalesce(F.col(ts) >= F.col("latched_at"), F.lit(False))).alias("reads_after_latch"))


def fan_out(published: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Deliveries of each message: subscriptions open when it was published.

    ``published(event_id, ts)``, ``subscribed(sub_at, unsub_at)`` with
    ``sub_at <= unsub_at``; open is ``[sub_at, unsub_at)``. Openings and
    closings are summed up to each message, within a day and carried over by
    one row a day, so that no message is joined with all subscriptions.
    """
    change = F.explode(
        F.array(
            F.struct(F.col("sub_at").alias("ts"), F.lit(1).alias("delta")),
            F.struct(F.col("unsub_at").alias("ts"), F.lit(-1).alias("delta")),
        )
    )
    changes = subscribed.select(change.alias("c")).select("c.ts", "c.delta", F.lit(None).cast("long").alias("event_id"))
    line = changes.union(published.select("ts", F.lit(0), "event_id")).withColumn("day", F.to_date("ts"))
    net = line.groupBy("day").agg(F.sum("delta").alias("net"))
    carried = net.select(
        "day", F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried")
    )
    # at one moment, changes come before messages
    within = Window.partitionBy("day").orderBy("ts", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("open", F.sum("delta").over(within))
        .where(F.col("event_id").isNotNull())
        .join(carried, "day")
        .select("event_id", (F.col("open") + F.col("carried")).cast("long").alias("deliveries"))
    )


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """How often each state follows each other within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = events.select(F.col(state).alias("s0"), F.lead(state).over(w).alias("s1")).where("s1 IS NOT NULL")
    return pairs.groupBy("s0", "s1").agg(F.count("*").alias("n"))


def last_operation_wins(events: DataFrame, member: str, kind: str, order: list[str], add: str, delete: str) -> DataFrame:
    """Members whose last add or delete is an add."""
    ops = events.where(F.col(kind).isin(add, delete))
    last = ops.groupBy(member).agg(F.max_by(kind, F.struct(*order)).alias("op"))
    return last.where(F.col("op") == add).select(F.col(member).alias("member"))


def ordered_set(members: DataFrame, column: str = "member", buckets: int = 200) -> DataFrame:
    """``members`` with ``idx``, their place from 0 in ascending order.

    Members are dealt to buckets by quantiles; places are counted within a
    bucket and shifted by the sizes of the buckets before, of which there are
    ``buckets`` at most.
    """
    cuts = members.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    dealt = members.withColumn("bucket", F.size(F.filter(edges, lambda c: c < F.col(column))))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("bucket").orderBy(column)
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(shifts), "bucket")  # at most ``buckets`` rows
        .select(column, (F.col("place") + F.col("shift")).cast("long").alias("idx"))
    )


def join_responses(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Requests with their answers as ``result``: a struct of value and error."""
    answer = responses.select(key, F.struct("value", "error").alias("result"))
    return requests.join(answer, key, "left")
