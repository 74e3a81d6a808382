"""Exactly-once ingest of messages into a ledger with dense offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Ledger:
    """Events by stream and offset, one directory for each micro-batch.

    A batch is written over itself if it is run again, and reads only batches
    before it; so a failure at any point leaves neither a gap nor a repeat.
    Within a batch, a stream's order is that of ``order``; a later batch gets
    higher offsets.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str, message: str, order: list[str], schema: str):
        self.spark, self.path, self.stream, self.message, self.order = spark, path, stream, message, order
        self.schema = schema

    def _files(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)  # noqa: SLF001
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))  # noqa: SLF001

    def read(self, before: int | None = None) -> DataFrame:
        schema = f"{self.schema}, stream_offset bigint"
        if not self._files():
            return self.spark.createDataFrame([], schema + ", batch_id bigint")
        rows = self.spark.read.schema(schema + ", batch_id bigint").option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Append what is new of a micro-batch; safe to call again."""
        known = self.read(before=batch_id)
        new = batch.dropDuplicates([self.message]).join(known.select(self.message), self.message, "left_anti")
        tails = known.groupBy(self.stream).agg((F.max("stream_offset") + 1).alias("tail"))
        place = F.row_number().over(Window.partitionBy(self.stream).orderBy(*self.order)).cast("long") - 1
        placed = (
            new.withColumn("place", place)
            .join(tails, self.stream, "left")
            .withColumn("stream_offset", F.col("place") + F.coalesce("tail", F.lit(0)))
            .drop("place", "tail")
        )
        placed.select(*batch.columns, "stream_offset").write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def ingest(self, source: DataFrame, checkpoint: str, hook: Callable[[int], None] | None = None) -> StreamingQuery:
        """Take all that a streaming source has now, then stop. ``hook`` runs before each batch."""

        def each(batch: DataFrame, batch_id: int) -> None:
            if hook:
                hook(batch_id)
            self.write_batch(batch, batch_id)

        return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project(ledger: Ledger, fold: Callable[[DataFrame], DataFrame], state: DataFrame | None, applied: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A read model kept up to date: events after those applied, folded in.

    ``fold`` takes events and gives ``key, value`` sums; ``state`` is its last
    result and ``applied`` the next offset of each stream.
    """
    rows = ledger.read()
    if applied is not None:
        rows = rows.join(applied, ledger.stream, "left").where(F.col("stream_offset") >= F.coalesce("next_offset", F.lit(0))).drop("next_offset")
    new = fold(rows)
    merged = new if state is None else state.union(new).groupBy("key").agg(F.sum("value").alias("value"))
    return merged, ledger.read().groupBy(ledger.stream).agg((F.max("stream_offset") + 1).alias("next_offset"))
