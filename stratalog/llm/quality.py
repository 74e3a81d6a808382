"""Text quality: random Fourier features of document statistics, ridge, isotonic.

One pass over the texts gives each document a short vector of statistics.
Standardised, it is mapped to random Fourier features, whose inner products
approximate a Gaussian kernel. Ridge regression on them needs only sums over
rows, which partitions form by themselves; 1000 bins of raw scores then give a
monotone map from score to the chance of label 1.

Defined cases: a null or empty text has zero statistics and gets a score like
any other; labels that are null are not learned from; without labels every
score is 0.5; repeated rows are scored alike, and a repeated label counts
once, the smallest of several for one id; a null id is passed on; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, stage
from .learning import isotonic, labelled, partition_sum

_MARKS = b".,;:!?|#$%&*\"'()-_/\\=<>@{}[]"
N_STATS = 17 + len(_MARKS)


def document_statistics(text: str | None) -> np.ndarray:
    """Shares, lengths and repetition of a whole text."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    data = text.encode()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    words = text.split()
    lines = text.split("\n")
    k = max(1, len(words))
    share = count / n
    upper, lower, digit = share[65:91].sum(), share[97:123].sum(), share[48:58].sum()
    used = share[share > 0]
    distinct = len(set(words))
    pairs = set(zip(words, words[1:]))
    threes = set(zip(words, words[1:], words[2:]))
    out[:17] = (
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        upper,
        lower,
        digit,
        share[128:].sum(),
        share[32] + share[10],
        n / k,
        distinct / k,
        len(pairs) / max(1, k - 1),
        len(threes) / max(1, k - 2),
        sum([a == b for a, b in zip(words, words[1:])]) / k,
        len(set(lines)) / len(lines),
        -(used * np.log2(used)).sum(),
        np.log1p(k / len(lines)),
        sum([w[-1] in ".,;:!?" for w in words]) / k,
    )
    out[17:] = np.sqrt([share[m] for m in _MARKS])
    return out


class Fourier:
    """``cos`` features of a Gaussian kernel over standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        wave = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([wave, np.ones((len(z), 1))])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train_fold,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    features: int = 256,
    ridge: float = 1e-3,
    seed: int = 11,
    bins: int = 1000,
) -> DataFrame:
    """``doc_id, score, predicted``. ``train_fold`` tells which label rows to learn from."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": [document_statistics(t) for t in part["text"].tolist()]})

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = stage(map_rows(slim, describe, "doc_id long, x array<double>"), "statistics")
    train = stage(labelled(stats, labels, id_col, label_col, train_fold), "train")

    def moments(part: pd.DataFrame) -> np.ndarray:
        x = np.stack(part["x"].to_numpy())
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = partition_sum(train, moments, 1 + 2 * N_STATS)
    n = max(1.0, m[0])
    mean = m[1 : 1 + N_STATS] / n
    spread = np.sqrt(np.maximum(m[1 + N_STATS :] / n - mean**2, 0))
    fourier = Fourier(mean, np.where(spread > 1e-9, spread, 1.0), features, seed)
    d = features + 1

    def normal(part: pd.DataFrame) -> np.ndarray:
        z, y = fourier(np.stack(part["x"].to_numpy())), part["y"].to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    if m[0]:
        sums = partition_sum(train, normal, d * d + d)
        w = np.linalg.solve(sums[: d * d].reshape(d, d) + ridge * n * np.eye(d) / features, sums[d * d :])
    else:
        w = np.zeros(d)

    def histogram(part: pd.DataFrame) -> np.ndarray:
        raw = fourier(np.stack(part["x"].to_numpy())) @ w
        at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, part["y"].to_numpy(), minlength=bins)])

    h = partition_sum(train, histogram, 2 * bins)
    seen = h[:bins] > 0
    if seen.any():
        middle = (np.arange(bins) + 0.5) / bins * 2 - 0.5
        knots, levels = isotonic(middle[seen], (h[bins:] / np.maximum(h[:bins], 1))[seen], h[:bins][seen])
    else:
        knots, levels = np.zeros(1), np.full(1, 0.5)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                raw = fourier(np.stack(part["x"].to_numpy())) @ w
                # a trace of the raw score keeps the order within a level
                score = np.clip(0.999 * np.interp(raw, knots, levels) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    return map_rows(stats, predict, "doc_id long, score double, predicted int")
