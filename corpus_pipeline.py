"""A training-corpus pipeline: five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import crc_bucket, stage, table
from stratalog.llm.decontaminate import contaminated
from stratalog.llm.language_id import identify
from stratalog.llm.line_dedup import line_dedup
from stratalog.llm.minhash_dedup import near_duplicates
from stratalog.llm.packing import pack_documents
from stratalog.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this score, which few texts in a learned language get, no language is accepted.
LEAST_LANGUAGE_SCORE = 0.3
#: What a packing worker holds at once: little, as the stages before it leave their executors' heaps full.
PACKING_MEMORY = {"remember": 150_000, "block_chars": 1_000_000}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no learned language go."""
    found = stage(identify(docs, crc_bucket("doc_id", 4) != 2), "languages")
    gone = found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SCORE)).select("doc_id")
    return _without(docs, gone)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds."""
    done = line_dedup(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    return done.select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    found = stage(near_duplicates(docs, width=5), "copies")
    return _without(docs, found.where("NOT kept").select("doc_id"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, stage(found.select("doc_id").distinct(), "leaks"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, placed in sequences of 2048 tokens."""
    return pack_documents(docs, public_path("word_bpe_49k.json"), **PACKING_MEMORY)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", packed),
]

#: Trained models and tokenizers have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` less the ids of ``gone``, which is broadcast only up to a number of rows."""
    if gone.limit(broadcast_rows + 1).count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"after-{k}")
    return docs
