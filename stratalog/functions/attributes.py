"""Typed attributes of spans and log entries, as map entries of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer binary values are cut, and their key says so.
BINARY_LIMIT = 64


def entry(key: Column | str, value: Column) -> Column:
    name = F.lit(key) if isinstance(key, str) else key
    return F.struct(name.alias("key"), value.cast("string").alias("value"))


def string(key: str, value: Column) -> Column:
    return entry(key, value)


def boolean(key: str, value: Column) -> Column:
    return entry(key, value.cast("boolean"))


def integer(key: str, value: Column) -> Column:
    return entry(key, value.cast("bigint"))


def double(key: str, value: Column) -> Column:
    return entry(key, value.cast("double"))


def time(key: str, value: Column) -> Column:
    """A moment in UTC, to the microsecond."""
    return entry(key, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def duration(key: str, micros: Column) -> Column:
    """A length of time, in microseconds, as seconds."""
    return entry(key, (micros / 1_000_000).cast("decimal(20,6)"))


def binary(key: str, value: Column) -> Column:
    """Hexadecimal digits of at most 64 bytes; a cut value's key ends in ``_truncated``."""
    long = F.length(value) > BINARY_LIMIT
    name = F.when(long, F.lit(key + "_truncated")).otherwise(F.lit(key))
    return entry(name, F.lower(F.hex(F.substring(value, 1, BINARY_LIMIT))))


def uuid(key: str, value: Column) -> Column:
    return entry(key, F.lower(value))


def type_name(key: str, value: Column) -> Column:
    return entry(key, F.typeof(value))


def attribute_map(*entries: Column) -> Column:
    """Attributes as a map, without those whose value is null; the last of a key wins."""
    given = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    first = F.filter(given, lambda e, i: ~F.exists(F.slice(given, i + 2, F.size(given)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(first)
