"""Language identification in two steps: the family, then the language in it.

A text is the hashed counts of its lower-case letter 1- to 3-grams (bytes of
UTF-8, white space and marks as one separator), square-rooted and normalised.
Linear support vector machines tell families apart, one against the rest; in a
family, one machine for each pair of languages votes by its margin.

The machines are fitted on the driver to a bounded sample: about
``sample_per_language`` labelled rows of each language, chosen by a hash of
the id. Every row is scored on its whole text.

Defined cases: a null text, or one without any letter, is ``und`` with score
0; null labels and rows without an id are not learned from, and of rows with
one id the smallest text is; without labels all texts are ``und``;
with one language it is the answer for all; repeated rows are scored alike;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows
from .learning import bounded_sample, logistic, sigmoid

# Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, other ASCII as a separator, all else as it is.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SIZE = 4096


def family(code: str) -> str:
    return _FAMILY_OF.get(code, f"language:{code}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def ngram_vector(text: str) -> np.ndarray:
    data = text if text.isascii() else text.lower()
    b = np.frombuffer(b" " + data.encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    one = b[1:-1] * np.uint32(2654435761)
    two = (b[:-1] * np.uint32(257) + b[1:] + np.uint32(70_000)) * np.uint32(2654435761)
    three = ((b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(257) + b[2:] + np.uint32(9_000_000)) * np.uint32(2654435761)
    keep = b[1:-1] != 32
    codes = np.concatenate([one[keep], two[:-1][keep], three[keep]]) >> np.uint32(20)
    x = np.sqrt(np.bincount(codes, minlength=SIZE)[:SIZE]).astype(np.float32)
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 300.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; y is +1 or -1.

    Accelerated gradient steps, in single precision; both classes weigh alike.
    """
    z = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.astype(np.float32)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(z.shape[1], np.float32)
    ahead, pace, reach = w, np.float32(1 / (1 + 4 * c)), np.float32(2 * c)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - pace * (ahead - reach * ((balance * y * gap) @ z))
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class LanguageModel:
    """Fitted machines. ``predict`` takes rows of ``ngram_vector``."""

    def __init__(self, x: np.ndarray, langs: list[str], labels: np.ndarray):
        self.langs = langs
        self.families = sorted({family(v) for v in langs})
        self.members = {f: [i for i, v in enumerate(langs) if family(v) == f] for f in self.families}
        of = np.array([self.families.index(family(v)) for v in langs], dtype=int)[labels] if len(langs) else labels
        self.machines: list[np.ndarray] = []
        self.scales: list[float] = []
        self.family_at = {f: self._fit(x, np.where(of == i, 1, -1)) for i, f in enumerate(self.families)} if len(self.families) > 1 else {}
        self.pair_at = {}
        for members in self.members.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = (labels == a) | (labels == b)
                    self.pair_at[a, b] = self._fit(x[rows], np.where(labels[rows] == a, 1, -1))
        self.w = np.stack(self.machines, axis=1).astype(np.float32) if self.machines else np.zeros((SIZE + 1, 0), np.float32)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> int:
        w = fit_svm(x, y)
        self.machines.append(w)
        margin = (x @ w[:-1] + w[-1])[:, None]
        self.scales.append(max(0.5, float(logistic(margin, (y > 0).astype(float), np.array([3.0, 0.0]), 1.0)[0])))
        return len(self.machines) - 1

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and a score from 0 to 1."""
        chance = sigmoid((x @ self.w[:-1] + self.w[-1]) * np.array(self.scales, np.float32)) if self.machines else np.zeros((len(x), 0))
        total = np.zeros((len(x), len(self.langs)))
        for f in self.families:
            own = chance[:, self.family_at[f]] if self.family_at else np.ones(len(x))
            members = self.members[f]
            for a in members:
                votes = [chance[:, self.pair_at[a, b]] if a < b else 1 - chance[:, self.pair_at[b, a]] for b in members if b != a]
                # the family decides first: its languages cannot overtake a likelier family
                total[:, a] = own * (np.mean(votes, axis=0) if votes else 1.0)
        of = np.array([self.families.index(family(v)) for v in self.langs])
        if self.family_at:
            best = np.stack([chance[:, self.family_at[f]] for f in self.families], axis=1).argmax(1)
            total = np.where(of[None, :] == best[:, None], total, -1.0)
        at = total.argmax(1)
        return at, np.clip(total[np.arange(len(x)), at], 0, 1)


def identify(
    docs: DataFrame,
    train_fold: Column,
    train: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = 800,
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``.

    Rows of ``train`` (``docs`` if not given) in the fold give the sample.
    """
    bound_batches(docs.sparkSession)
    source = (docs if train is None else train).where(train_fold & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = bounded_sample(rows, "doc_id", "lang", sample_per_language)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part[[has_letter(t) for t in part["text"].tolist()]]
            yield pd.DataFrame({"lang": part["lang"], "x": [ngram_vector(t).astype("<f2").tobytes() for t in part["text"].tolist()]})

    got = sample.mapInPandas(vectors, "lang string, x binary").collect()
    langs = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(r["x"], "<f2").astype(np.float32) for r in got]) if got else np.zeros((0, SIZE), np.float32)
    model = LanguageModel(x, langs, np.array([langs.index(r["lang"]) for r in got], dtype=int))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part["text"].tolist()
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            good = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
            for k in range(0, len(good), 256):
                cut = good[k : k + 256]
                at, score = model.predict(np.stack([ngram_vector(texts[i]) for i in cut]))
                names[cut], scores[cut] = [model.langs[a] for a in at], score
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names, "score": scores})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(slim, predict, "doc_id long, lang_pred string, score double")
