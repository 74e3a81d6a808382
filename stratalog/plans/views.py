"""Logs, journals and heartbeats derived from the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import cluster, log
from stratalog.sources.tables import table

LEASE = "6 HOURS"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as streams, with dense offsets."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("message_id"), "event_type", "ts", F.to_date("ts").alias("d")
    )
    return log.assign_offsets(events, "stream_id", ["ts", "message_id"], F.to_date("ts"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One append record for each stream and day."""
    return log.append_records(stream(spark, sf_dir), "d")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded events of each command that has any."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("command_id"))
    return lines.agg(F.count("*").alias("n_events"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("command_id"), F.col("o_orderpriority").alias("handler"))


def handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("P", "F"))
    joined = orders.select(F.col("o_orderkey").alias("command_id")).join(event_counts(spark, sf_dir), "command_id", "left")
    return joined.select("command_id", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("command_id"))
    return orders.select(F.col("o_orderkey").alias("command_id")).join(lines, "command_id", "left_semi")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("node_id"), "ts", "event_id")
    return cluster.heartbeats(events, LEASE)


def registry_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what nodes ask of the registry: signups register, errors deregister, all others renew."""
    op = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "deregister").otherwise("renew")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("node_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), op.alias("op"))


def keyspace_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values by time; an error deletes the key."""
    value = F.when(F.col("event_type") != "error", F.col("event_type")).alias("value")
    return table(spark, sf_dir, "events").select("user_id", value, F.struct("ts", "event_id").alias("v"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which anything happened."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("poll_at")
    return table(spark, sf_dir, "events").select(day).distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("node_id"))


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("workload"))
