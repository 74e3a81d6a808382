"""The corpus operators as registered queries over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, shared_dir, table
from .decontaminate import contaminated
from .embedding_dedup import near_duplicate_vectors
from .language_id import identify
from .line_dedup import line_dedup
from .minhash_dedup import near_duplicates
from .oracles import ORACLES  # noqa: F401
from .packing import pack_documents
from .quality import score_quality
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .tokens import public_path
from .toxicity import score_toxicity


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_bucket("doc_id", 3) == 1
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_bucket("doc_id", 4) == 2
    found = identify(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_bucket("doc_id", 5) == 0
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_clauses")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), limit=1024)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/stratalog/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return read_token_files(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
        F.array_join(F.col("keep_runs").cast("array<string>"), ",").alias("keep_runs"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_quality,
        op3_packing,
        op4_language_id,
        op5_toxicity,
        op6_token_counts,
        op7_token_files,
        op8_line_dedup,
        op9_embedding_dedup,
        op10_decontamination,
    )
}
