"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.sources.shared import shared_dir

#: White space that separates words and is stripped from lines: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: later work re-reads committed files, so a lost
    executor costs a re-read and never a re-computation of what led here.
    Shuffle files of the write are removed as soon as it is committed.
    """
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/stratalog/{label}-{uuid.uuid4().hex}"
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, each by the folder of its files.

    Only what no later work reads may go: whatever was made of it must itself
    be written by now.
    """
    for df in staged:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession  # noqa: SLF001
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file)).getParent()
            folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)


def map_rows(df: DataFrame, run: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``mapInPandas`` with the columns ``ids`` as strings inside.

    pandas turns a batch of whole numbers that holds a null into doubles, and
    ids above 2**53 would change.
    """
    into = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns})
    for c in ids:
        schema = schema.replace(f"{c} long", f"{c} string")
    return into.mapInPandas(run, schema).withColumns({c: F.col(c).cast("long") for c in ids})


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text, split at white space; null for a null text."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != F.lit(""))


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold that a row belongs to."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def keep_ids(df: DataFrame, ids: DataFrame, column: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Semi-join on ``column``. ``ids`` is broadcast only if it has at most
    ``broadcast_rows`` rows (8 MB of keys); otherwise both sides are shuffled."""
    side = F.broadcast(ids) if small_enough(ids, broadcast_rows) else ids
    return df.join(side, column, "left_semi")


def bound_batches(spark: SparkSession, size: str = "16m", rows: int = 2000) -> None:
    """Bound the Arrow batches of later queries, as texts may be very long.

    The default of 10,000 rows a batch is meant for rows of a few bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
