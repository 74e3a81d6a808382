"""Journals, keyspaces and sets as Parquet tables.

A journal is written one directory for each batch, so that a batch that is
written again replaces itself. One writer for each table: plain Parquet has no
transactions, and the position check below does not guard against a second
writer between its read and its write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The journal's end is not where the writer expected it."""


def journal_name(kind: str, key: str) -> str:
    """The name of a journal, such as ``eventstream:<id>`` or ``integration:<id>``."""
    return f"{kind}:{key}"


class Journal:
    """An ordered log by position, for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "stream_id", pos: str = "pos"):
        self.spark, self.path, self.schema, self.key, self.pos = spark, path, schema, key, pos

    def read(self) -> DataFrame:
        """All records. Filters on key and position reach the files."""
        spark = self.spark
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)  # noqa: SLF001
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        if not fs.exists(hadoop):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema + ", batch_id bigint").option("basePath", self.path).parquet(self.path).drop("batch_id")

    def bounds(self) -> DataFrame:
        """``[begin_pos, end_pos)`` of each key."""
        return self.read().groupBy(self.key).agg(F.min(self.pos).alias("begin_pos"), (F.max(self.pos) + 1).alias("end_pos"))

    def scan(self, begin: int, end: int | None = None) -> DataFrame:
        """Records from ``begin`` on, in order within each key."""
        rows = self.read().where(F.col(self.pos) >= begin)
        if end is not None:
            rows = rows.where(F.col(self.pos) < end)
        return rows.sortWithinPartitions(self.key, self.pos)

    def last(self) -> DataFrame:
        return last_record(self.read(), self.key, self.pos)

    def append(self, records: DataFrame, batch_id: int) -> None:
        """Add records whose positions follow the end of their keys without a gap.

        The same ``batch_id`` again replaces the batch. Raises ``Conflict`` if
        a key's positions do not begin where the other batches end.
        """
        before = self._others(batch_id).groupBy(self.key).agg((F.max(self.pos) + 1).alias("end"))
        new = records.groupBy(self.key).agg(
            F.min(self.pos).alias("lo"), F.max(self.pos).alias("hi"), F.count("*").alias("n"), F.countDistinct(self.pos).alias("d")
        )
        wrong = new.join(before, self.key, "left").where(
            "(end IS NOT NULL AND lo <> end) OR (end IS NULL AND lo <> 0) OR hi - lo + 1 <> n OR d <> n"
        )
        if bad := wrong.limit(1).collect():
            raise Conflict(f"positions of {bad[0][self.key]} do not follow the end of its journal")
        records.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def _others(self, batch_id: int) -> DataFrame:
        rows = self.read()
        return rows.where(~F.input_file_name().contains(f"/batch_id={batch_id}/"))

    def truncated(self, begin: int) -> DataFrame:
        """What is left when all before ``begin`` goes; write it to a new place to free the files."""
        return truncate(self.read(), begin, self.pos)


def truncate(records: DataFrame, begin: int, pos: str = "pos") -> DataFrame:
    """``records`` from position ``begin`` on."""
    return records.where(F.col(pos) >= begin)


def last_record(records: DataFrame, key: str, pos: str) -> DataFrame:
    """The record with the largest position of each key, merged map-side."""
    whole = F.struct(*records.columns)
    return records.groupBy(key).agg(F.max_by(whole, pos).alias("r")).select("r.*")


def latest_by_key(versions: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """A keyspace from its writes: the newest value of each key; a null value is a deletion.

    The struct around a value is never null, so that a deletion hides what was before.
    """
    newest = versions.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v")), version).alias("s"))
    return newest.where("s.v IS NOT NULL").select(key, F.col("s.v").alias(value))


def get(versions: DataFrame, keys: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """Each of ``keys`` with its newest value, null if it has none or was deleted.

    Only the writes of these keys are folded.
    """
    asked = keys.select(key).distinct()
    found = latest_by_key(versions.join(asked, key, "left_semi"), key, value, version)
    return asked.join(found, key, "left")


def members(inserts: DataFrame, column: str) -> DataFrame:
    """A set from its inserts; inserting twice changes nothing."""
    return inserts.select(column).where(F.col(column).isNotNull()).distinct()


def has(rows: DataFrame, members_: DataFrame, column: str) -> DataFrame:
    """``rows`` that are in the set."""
    return rows.join(members_, column, "left_semi")


def has_not(rows: DataFrame, members_: DataFrame, column: str) -> DataFrame:
    """``rows`` that are not in the set."""
    return rows.join(members_, column, "left_anti")


def dense_positions(rows: DataFrame, key: str, order: list[str], tails: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``pos``, from 0 or from each key's ``tail`` on, without gaps."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("pos", F.row_number().over(w).cast("long") - 1)
    if tails is not None:
        out = out.join(tails, key, "left").withColumn("pos", F.col("pos") + F.coalesce("tail", F.lit(0))).drop("tail")
    return out
