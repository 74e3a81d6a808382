"""Readers for tables in any format that Spark reads."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_dsn(spark: SparkSession, dsn: str) -> DataFrame:
    """``format+scheme://path?option=value``, or a plain path for Parquet.

    ``parquet+s3a://bucket/key``, ``json+file:///logs?multiLine=true`` and so on;
    ``jdbc:`` addresses need ``dbtable`` among the options.
    """
    if dsn.startswith("jdbc:"):
        url, _, query = dsn.partition("?")
        options = dict(parse_qsl(query))
        if "dbtable" not in options and "query" not in options:
            raise ValueError("a jdbc address needs dbtable or query among its options")
        return spark.read.format("jdbc").options(url=url, **options).load()
    parts = urlsplit(dsn)
    kind, plus, scheme = parts.scheme.partition("+")
    if not plus:
        return spark.read.parquet(dsn)
    path = f"{scheme}://{parts.netloc}{parts.path}"
    return spark.read.format(kind).options(**dict(parse_qsl(parts.query))).load(path)
