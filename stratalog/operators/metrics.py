"""Counters, gauges and histograms over operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(rows: DataFrame, attributes: list[str], value: Column | None = None, name: str = "n") -> DataFrame:
    """A monotonic sum (or count) by attributes."""
    total = F.count("*") if value is None else F.sum(value).cast("long")
    return rows.groupBy(*attributes).agg(total.alias(name))


def operations(rows: DataFrame, operation: str, failed: Column) -> DataFrame:
    """Operations and errors by operation."""
    return rows.groupBy(F.col(operation).alias("operation")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))


def span_changes(rows: DataFrame, operation: str, start: str, duration: str) -> DataFrame:
    """+1 at the start of each span and -1 at its end."""
    both = F.array(
        F.struct(F.col(start).alias("change_at"), F.lit(1).alias("delta")),
        F.struct((F.col(start) + F.expr(f"INTERVAL {duration}")).alias("change_at"), F.lit(-1).alias("delta")),
    )
    return rows.select(F.col(operation).alias("operation"), F.explode(both).alias("c")).select("operation", "c.*")


def peak_in_flight(changes: DataFrame) -> DataFrame:
    """The most operations in flight at once, by operation.

    Operations are few and may each hold a third of all rows. So sums run
    within an operation's day; one row for each day carries them over.
    """
    day = F.to_date("change_at")
    within = Window.partitionBy("operation", "day").orderBy("change_at", "delta").rowsBetween(Window.unboundedPreceding, 0)
    days = (
        changes.withColumn("day", day)
        .withColumn("level", F.sum("delta").over(within))
        .groupBy("operation", "day")
        .agg(F.sum("delta").alias("net"), F.max("level").alias("top"))
    )
    before = Window.partitionBy("operation").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return (
        days.withColumn("carried", F.coalesce(F.sum("net").over(before), F.lit(0)))
        .groupBy("operation")
        .agg(F.max(F.col("carried") + F.col("top")).cast("long").alias("peak"))
    )


def histogram(rows: DataFrame, operation: str, value: str, width: float) -> DataFrame:
    """Counts by operation and bucket ``floor(value / width)``."""
    bucket = F.floor(F.col(value) / width).cast("long").alias("bucket")
    return rows.groupBy(F.col(operation).alias("operation"), bucket).agg(F.count("*").alias("n"))


def spans(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Spans from their starts and ends; a span without an end has a null duration."""
    return starts.join(ends.select(key, F.col("ts").alias("end_ts")), key, "left").withColumn(
        "duration_us", F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    )
