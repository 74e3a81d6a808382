"""Event streams: dense offsets, append records, search and idempotent appends.

Windows are partitioned by the stream, which is the unit of order. A stream
that holds much of all events is numbered in parts (``chunk``); windows over
append records see one row for each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_offsets(events: DataFrame, stream: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """``events`` with ``stream_offset``: 0, 1, 2 … within each stream.

    ``chunk`` never falls along the order, as the day of a time does not. With
    it events are numbered within stream and chunk and moved on by the sizes of
    the chunks before, so that no task reads a stream whole.
    """
    if chunk is None:
        w = Window.partitionBy(stream).orderBy(*order)
        return events.withColumn("stream_offset", F.row_number().over(w).cast("long") - 1)
    parts = events.withColumn("_chunk", chunk)
    near = Window.partitionBy(stream, "_chunk").orderBy(*order)
    earlier = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(F.col(stream).alias("_s"), F.col("_chunk").alias("_c")).agg(F.count("*").alias("_n"))
    moves = sizes.select("_s", "_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_move"))
    same = F.col(stream).eqNullSafe(F.col("_s")) & F.col("_chunk").eqNullSafe(F.col("_c"))
    numbered = parts.withColumn("_at", F.row_number().over(near).cast("long") - 1).join(moves, same)
    return numbered.withColumn("stream_offset", F.col("_at") + F.col("_move")).drop("_chunk", "_at", "_s", "_c", "_move")


def scan_range(events: DataFrame, begin: int, end: int) -> DataFrame:
    """Events with offsets in ``[begin, end)``."""
    return events.where((F.col("stream_offset") >= begin) & (F.col("stream_offset") < end))


def append_records(events: DataFrame, batch: str) -> DataFrame:
    """One record for each batch of a stream: its half-open offset range.

    ``events`` needs ``stream_id``, ``stream_offset``, ``message_id`` and the
    batch column; a batch's offsets are contiguous.
    """
    batches = events.groupBy("stream_id", batch).agg(
        F.min("stream_offset").alias("offset_before"),
        (F.max("stream_offset") + 1).alias("offset_after"),
        F.min("message_id").alias("first_message_id"),
        F.count("*").alias("n_events"),
    )
    w = Window.partitionBy("stream_id").orderBy(batch)
    return batches.select(
        "stream_id",
        (F.row_number().over(w).cast("long") - 1).alias("pos"),
        "offset_before",
        "offset_after",
        "first_message_id",
        "n_events",
    )


def bounds(records: DataFrame) -> DataFrame:
    """First and next position of each stream, and its next offset."""
    return records.groupBy("stream_id").agg(
        F.min("pos").alias("begin_pos"), (F.max("pos") + 1).alias("end_pos"), F.max("offset_after").alias("next_offset")
    )


def search_by_offset(records: DataFrame, offset: int) -> DataFrame:
    """The record of each stream that holds an offset."""
    return records.where((F.col("offset_before") <= offset) & (F.col("offset_after") > offset))


def contiguity(records: DataFrame) -> DataFrame:
    """Records of each stream, and how many do not begin where the one before ends."""
    w = Window.partitionBy("stream_id").orderBy("pos")
    gap = F.when(F.lag("offset_after", 1, 0).over(w) == F.col("offset_before"), 0).otherwise(1)
    return records.withColumn("gap", gap).groupBy("stream_id").agg(
        F.count("*").alias("n_records"), F.sum("gap").cast("long").alias("gaps")
    )


def require_events(requests: DataFrame, n_events: str = "n_events") -> DataFrame:
    """``requests``; an append without events fails the query."""
    checked = F.assert_true(F.col(n_events) > 0, F.lit("an append needs at least one event"))
    return requests.where(checked.isNull())


def answer_appends(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Offsets for append requests, without appending again what was appended.

    ``requests(stream_id, first_message_id, n_events, hint)``. An earlier
    record answers a request if it begins with the same message and does not
    lie wholly below the hint; the first message alone identifies a batch.
    Otherwise the events go to the end of the stream.
    """
    tails = records.groupBy("stream_id").agg(F.max("offset_after").alias("next_offset"))
    prior = records.select("stream_id", "first_message_id", "pos", "offset_before", "offset_after")
    asked = requests.join(tails, "stream_id").alias("q")
    found = asked.join(
        prior.alias("p"),
        (F.col("p.stream_id") == F.col("q.stream_id"))
        & (F.col("p.first_message_id") == F.col("q.first_message_id"))
        & (F.col("q.hint") < F.col("q.next_offset"))
        & (F.col("p.offset_after") > F.col("q.hint")),
        "left",
    )
    return found.select(
        "q.stream_id",
        "q.first_message_id",
        F.coalesce("p.offset_before", "q.next_offset").alias("begin_offset"),
        F.coalesce(F.col("p.offset_after"), F.col("q.next_offset") + F.col("q.n_events")).alias("end_offset"),
        F.col("p.pos").isNotNull().alias("by_prior"),
    )
