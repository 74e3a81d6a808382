"""What the trained operators share: partition sums, samples and calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_sum(df: DataFrame, fold: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``fold`` over all batches of ``df``.

    Each partition gives one vector; these are summed again in about as many
    tasks as the square root of their number, and that many reach the driver.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in batches:
            if len(part):
                total += fold(part)
        yield pd.DataFrame({"v": [total]})

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in batches:
            for v in part["v"]:
                total += v
        yield pd.DataFrame({"v": [total]})

    sums = df.mapInPandas(first, "v array<double>")
    groups = max(1, math.isqrt(sums.rdd.getNumPartitions()))
    rows = sums.repartition(groups).mapInPandas(second, "v array<double>").collect()
    return np.sum([np.asarray(r["v"]) for r in rows], axis=0) if rows else np.zeros(size)


def bounded_sample(df: DataFrame, id_col: str, by: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each value of ``by``, chosen by a hash of the id.

    All ids of a value are kept if it has no more rows than ``bound``; of rows
    with one id the smallest is, and rows without an id are not. What is chosen
    depends on the rows alone, so that a re-run gives the same sample.
    """
    counts = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    chosen = df.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 20)) < share * (1 << 20)))
    rest = [c for c in df.columns if c != id_col]
    return chosen.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("row")).select(id_col, "row.*").select(*df.columns)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit to means ``y`` with weights ``w`` at sorted ``x``."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights and intercept of a logistic model, drawn towards ``prior``."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, pull = prior.astype(float).copy(), np.full(z.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull * (w - prior)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, fold: Column) -> DataFrame:
    """``rows`` with ``y``, for known labels whose fold is not held out."""
    known = labels.where(F.col(label_col).isNotNull() & fold).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")
    )
    return rows.join(known.groupBy("doc_id").agg(F.min("y").alias("y")), "doc_id")
