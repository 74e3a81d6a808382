"""Commands: acceptance, handling, recovery of unfinished work, lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = ("command_accepted", "command_handled", "events_appended_to_stream")


def accept(pushes: DataFrame, key: str, order: list[str], accepted: DataFrame | None = None) -> DataFrame:
    """``pushes`` with ``outcome``: the first push of a command is accepted.

    ``accepted`` holds ids from before; it outlives any journal.
    """
    w = Window.partitionBy(key).orderBy(*order)
    out = pushes.withColumn("_rank", F.row_number().over(w))
    fresh = F.col("_rank") == 1
    if accepted is not None:
        out = out.join(accepted.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
        fresh = fresh & F.col("_seen").isNull()
    out = out.withColumn("outcome", F.when(fresh, "accepted").otherwise("ignored_duplicate"))
    return out.drop("_rank", "_seen")


def unhandled(accepted: DataFrame, handled: DataFrame) -> DataFrame:
    """Accepted commands that no handler has finished."""
    return accepted.join(handled.select("command_id"), "command_id", "left_anti")


def unappended(handled: DataFrame, appended: DataFrame) -> DataFrame:
    """Handled commands whose events are not recorded as appended.

    Commands without events never are; keep ``n_events > 0`` for what is left
    to do.
    """
    return handled.join(appended.select("command_id"), "command_id", "left_anti")


def recovery_summary(accepted: DataFrame, handled: DataFrame, appended: DataFrame) -> DataFrame:
    """Counts by handler of accepted and unfinished commands, raw and effective."""
    state = accepted.join(handled.withColumn("is_handled", F.lit(True)), "command_id", "left").join(
        appended.select("command_id").withColumn("is_appended", F.lit(True)), "command_id", "left"
    )
    open_ = F.col("is_appended").isNull()
    return state.groupBy("handler").agg(
        F.count("*").alias("accepted"),
        F.count_if(F.col("is_handled").isNull()).alias("unhandled"),
        F.count_if(F.col("is_handled").isNotNull() & open_).alias("unappended"),
        F.count_if(F.coalesce(F.col("n_events") > 0, F.lit(False)) & open_).alias("to_append"),
    )


def recover(records: DataFrame) -> DataFrame:
    """Pending work from a journal of operations, in the order to finish it.

    ``records(handler_key, pos, op, command_id, n_events)``. Handled commands
    whose events were not appended come first, in journal order; then accepted
    ones that were not handled. ``effective`` is false for handled commands
    that recorded no event, for which there is nothing to do.
    """
    by_op = {op: records.where(F.col("op") == op) for op in OPERATIONS}
    keys = ["handler_key", "command_id"]
    first = by_op["command_handled"].join(by_op["events_appended_to_stream"].select(*keys), keys, "left_anti")
    second = by_op["command_accepted"].join(by_op["command_handled"].select(*keys), keys, "left_anti")
    return (
        first.select("handler_key", F.lit(1).alias("phase"), "pos", "command_id", (F.col("n_events") > 0).alias("effective"))
        .union(second.select("handler_key", F.lit(2), "pos", "command_id", F.lit(True)))
        .orderBy("handler_key", "phase", "pos")
    )


def ordinals(events: DataFrame, cause: str, order: list[str]) -> DataFrame:
    """``events`` with their ``ordinal`` within the command that caused them."""
    w = Window.partitionBy(cause).orderBy(*order)
    return events.withColumn("ordinal", F.row_number().over(w).cast("long") - 1)


def offset_hints(handled: DataFrame, stream: str, order: list[str], start: Column | None = None) -> DataFrame:
    """``handled`` with ``offset_hint``: the stream's offset before each command's events."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_events").over(w).cast("long"), F.lit(0).cast("long"))
    return handled.withColumn("offset_hint", before if start is None else before + start)


def sticky_stream(handled: DataFrame, handler: str, order: list[str], stream: str) -> DataFrame:
    """``handled`` with the stream of each handler's first command, to which it sticks."""
    w = Window.partitionBy(handler).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return handled.withColumn(stream, F.first(stream).over(w))


def envelope(
    message_id: Column,
    data: Column,
    created_at: Column,
    description: Column,
    media_type: Column,
    application: tuple[str, str],
    handler: tuple[str, str] | None = None,
    cause: Column | None = None,
) -> Column:
    """A message with its metadata. A cause gives the causation and correlation ids."""
    own = message_id.cast("string")

    def identity(pair: tuple[str, str] | None) -> Column:
        if pair is None:
            return F.lit(None).cast("struct<name:string,key:string>")
        return F.struct(F.lit(pair[0]).alias("name"), F.lit(pair[1]).alias("key"))

    return F.struct(
        own.alias("message_id"),
        (own if cause is None else cause["message_id"]).alias("causation_id"),
        (own if cause is None else cause["correlation_id"]).alias("correlation_id"),
        identity(application).alias("source_application"),
        identity(handler).alias("source_handler"),
        created_at.alias("created_at"),
        description.alias("description"),
        media_type.alias("media_type"),
        data.cast("binary").alias("data"),
    )


def unpack(message: Column, schema: str) -> Column:
    """The payload of an envelope with JSON data."""
    return F.from_json(message["data"].cast("string"), schema)


def handle(commands: DataFrame, handler: Callable[[dict], list[dict]], key: str, event_schema: str) -> DataFrame:
    """Run a handler over commands: one row for each event, with its ordinal.

    The handler sees one command as a dict and returns its events; commands
    come in Arrow batches.
    """
    names = [c.split()[0] for c in event_schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [
                (command[key], i, *[event.get(n) for n in names])
                for command in part.to_dict("records")
                for i, event in enumerate(handler(command))
            ]
            yield pd.DataFrame(out, columns=["causation_id", "ordinal", *names])

    kind = dict(commands.dtypes)[key]
    return commands.mapInPandas(run, f"causation_id {kind}, ordinal long, {event_schema}")


def lineage(events: DataFrame, commands: DataFrame, cause: str, correlation: str, kind: str) -> DataFrame:
    """Events counted by the command that caused them and its correlation id."""
    counted = events.groupBy(cause, kind).agg(F.count("*").alias("n"))  # before the join: fewer rows to shuffle
    return counted.join(commands, cause).groupBy(cause, correlation, kind).agg(F.sum("n").alias("n"))


def by_media_type(messages: DataFrame, routes: dict[str, str]) -> DataFrame:
    """``messages`` with the ``handler`` that their media type is routed to.

    A message without a route fails the query.
    """
    known = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    handler = F.element_at(known, F.col("media_type"))
    return messages.withColumn("handler", F.coalesce(handler, F.raise_error(F.concat(F.lit("no route for "), F.col("media_type"))).cast("string")))


def switch_operation(record: dict[str, Column], must: bool = True) -> Column:
    """Dispatch on a tagged union: the value of the case whose struct is set.

    ``record`` maps each operation's column to the value for that case. With
    ``must`` a row in which none is set fails the query.
    """
    out = None
    for name, value in record.items():
        out = F.when(F.col(name).isNotNull(), value) if out is None else out.when(F.col(name).isNotNull(), value)
    return out.otherwise(F.raise_error(F.lit("no operation is set"))) if must else out
