"""Token-id files: one concatenated id array with Elias-Fano boundaries.

Documents are range-partitioned and sorted by id, encoded, and written in
shards of bounded size. A shard is a row of a Parquet dataset, which Spark
commits, so that a lost executor costs a re-run task and no half-written file:

``part, shard``   place in the order of the whole
``base``          ids before the shard within its part
``n_docs, n_ids`` counts
``doc_ids``       ids of the documents, ascending
``width, low, high, samples``  Elias-Fano code of the documents' end offsets
``id_bytes, ids`` 2 or 4 bytes for an id, and the ids, little-endian

Defined cases: a null or empty text holds the end id alone; rows with one id
stay together, ordered by text; a null id comes first; an empty table gives no
shard; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, map_rows
from .eliasfano import EliasFano
from .tokens import PieceCodec

SHARD_SCHEMA = (
    "part int, shard int, base long, n_docs long, n_ids long, doc_ids array<long>, "
    "width int, low binary, high binary, samples binary, id_bytes int, ids binary"
)


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    style: str = "spaced",
    shard_ids: int = 1 << 20,
    remember: int = 900_000,
) -> None:
    """Encode ``docs`` and write shards of about ``shard_ids`` ids to ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, end = PieceCodec.shared(vocabulary, style, remember), np.array([end_id], "<u4").tobytes()
        small = codec.tokenizer.get_vocab_size() <= 1 << 16
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        names: list[int] = []
        held: list[bytes] = []
        ends: list[int] = []
        total = 0

        def row() -> pd.DataFrame:
            code = EliasFano.encode(ends, total)
            ids = np.frombuffer(b"".join(held), "<u4")
            stored = ids.astype("<u2") if small else ids
            values = (part, shard, base, len(ends), total, names, code.width, code.low, code.high, code.samples, 2 if small else 4, stored.tobytes())
            return pd.DataFrame([values], columns=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].tolist(), codec.encode_many(batch["text"].tolist())):
                ids += end
                held.append(ids)
                names.append(None if doc_id is None else int(doc_id))
                total += len(ids) >> 2
                ends.append(total)
                if total >= shard_ids:
                    yield row()
                    shard, base, total = shard + 1, base + total, 0
                    names, held, ends = [], [], []
        if ends:
            yield row()

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``shards`` with ``start``, the ids of the whole before each shard.

    Parts are as many as the partitions of the write, whatever the corpus
    holds; only their totals are summed in order and sent back to all tasks.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("before") + F.col("base")).drop("before")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples(index=False):
                ends = EliasFano(r.n_docs, r.width, r.low, r.high, r.samples).decode()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r.ids, "<u2" if r.id_bytes == 2 else "<u4").astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame(
                    {"doc_id": list(r.doc_ids), "start": starts + r.start, "n_tokens": ends - starts, "ids_crc32": crc}
                )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    cut = shard_starts(shards).select("start", "n_docs", "doc_ids", "width", "low", "high", "samples", "id_bytes", "ids").withColumn(
        "doc_ids", F.col("doc_ids").cast("array<string>")
    )
    return map_rows(cut, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
