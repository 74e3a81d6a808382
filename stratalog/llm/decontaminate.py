"""Benchmark passages in training documents: n-gram seeds, rarest first, then alignment.

Items are cut to word n-grams, and one pass over all documents finds where
these occur and how many documents hold each. A gram may leave out one word
between its first and last, in documents and in items of fewer than ``gapped``
words, as these may be edited so that no run of n words is left. Documents with
any of them are read again, and the words around each seed are aligned with the
item (Smith-Waterman: a match 2, a mismatch or a gap -1), places with the
rarest seed first. A place is passed over only if the words that it shares with the
item are too few for the threshold, or for more than the best score so far.
No seed is dropped for being frequent: edited copies may be many and hold
nothing else. The score is the best alignment's over a full match's.

Items are sent to the tasks in blocks of at most ``block_items``; a larger
benchmark takes more passes, never a larger broadcast.

Defined cases: a null text, or one without words, matches nothing; items with
fewer words than an n-gram use all their words as the n-gram; items without
words match nothing; equal items are reported each; repeated rows are reported
each; documents without an id are not reported, items without one are, with a
null; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, keep_ids, map_rows, stage

_WORD = re.compile(r"\w+")
RESULT = "doc_id long, item_id long, score double, n_seeds int, word_start int, word_end int"


def word_list(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def gram_shapes(size: int, gap: bool) -> list[tuple[int, ...]]:
    """Places of a gram's words after its first one; with ``gap``, also those that leave one word out."""
    out = [tuple(range(size))]
    if gap:
        out += [(*range(k), *range(k + 1, size + 1)) for k in range(1, size)]
    return out


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of ``a`` against ``b``, and where it ends and begins in ``b``."""
    row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
    begin_row = np.arange(len(b) + 1)
    begin, ramp, start = begin_row.copy(), np.arange(len(b) + 1), 0
    for x in a:
        step = np.where(b == x, 2, -1)
        up = row - 1
        diagonal = np.empty_like(row)
        diagonal[0], diagonal[1:] = 0, row[:-1] + step
        new = np.maximum(np.maximum(diagonal, up), 0)
        from_up = (up > diagonal) & (up > 0)
        new_begin = np.where(from_up, begin, np.concatenate([[0], begin[:-1]]))
        new_begin = np.where(new == 0, begin_row, new_begin)
        # a gap in a: the best cell to the left, less the distance
        lifted = new + ramp
        left = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == left, ramp, 0))
        new, begin = left - ramp, new_begin[source]
        row = new
        top = int(row.argmax())
        if row[top] > best:
            best, end, start = int(row[top]), top, int(begin[top])
    return best, start, end


class Items:
    """A block of benchmark items in the form that the tasks need."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int, gapped: int):
        self.n = n
        self.words: dict[str, int] = {}
        self.items: dict[int, tuple[int, np.ndarray]] = {}
        grams: dict[tuple[int, ...], int] = {}
        self.places: list[list[tuple[int, int]]] = []
        for key, (item_id, text) in enumerate(rows):
            ids = [self.words.setdefault(w, len(self.words)) for w in word_list(text)]
            if not ids:
                continue
            self.items[key] = (item_id, np.array(ids))
            size = min(n, len(ids))
            for shape in gram_shapes(size, size == n and len(ids) < gapped):
                for at in range(len(ids) - shape[-1]):
                    gram = grams.setdefault(tuple([ids[at + j] for j in shape]), len(self.places))
                    if gram == len(self.places):
                        self.places.append([])
                    self.places[gram].append((key, at))
        self.sizes = sorted({len(g) for g in grams})
        self.pair_codes = {s: self._codes(grams, s) for s in self.sizes}

    def _codes(self, names: dict[tuple[int, ...], int], size: int) -> tuple[np.ndarray, np.ndarray]:
        grams = [g for g in names if len(g) == size]
        codes = self._mix(np.array(grams, dtype=np.int64).T)
        order = np.argsort(codes)
        return codes[order], np.array([names[g] for g in grams])[order]

    @staticmethod
    def _mix(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def ids(self, text: str | None) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, -1) for w in word_list(text)], dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """Positions and n-grams of the items found in a document's words."""
        at_all: list[int] = []
        gram_all: list[int] = []
        known = ids >= 0
        for size in self.sizes:
            codes, names = self.pair_codes[size]
            for shape in gram_shapes(size, size == self.n):
                if len(ids) <= shape[-1]:
                    continue
                ends = len(ids) - shape[-1]
                ok = known[:ends].copy()
                for j in shape[1:]:
                    ok &= known[j : ends + j]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                found = self._mix([ids[at + j] for j in shape])
                place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                hit = codes[place] == found
                at_all += at[hit].tolist()
                gram_all += names[place[hit]].tolist()
        return at_all, gram_all


def _most(own: np.ndarray, window: np.ndarray) -> int:
    """No alignment of the two scores more than this."""
    return 2 * min(int(np.isin(own, window).sum()), int(np.isin(window, own).sum()))


def _one_block(docs: DataFrame, rows: list[tuple[int, str | None]], n: int, gapped: int, least: float) -> DataFrame:
    spark = docs.sparkSession
    items = Items(rows, n, gapped)
    sent = spark.sparkContext.broadcast(items)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        for part in batches:
            out = []
            for doc_id, text in zip(part["doc_id"].tolist(), part["text"].tolist()):
                grams = block.hits(block.ids(text))[1]
                if grams:
                    out.append((doc_id, sorted(set(grams))))
            yield pd.DataFrame(out, columns=["doc_id", "grams"])

    hits = stage(map_rows(docs, find, "doc_id long, grams array<int>"), "hits")
    counted = hits.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    held = np.zeros(len(items.places), dtype=np.int64)
    for r in counted.collect():  # n-grams of one block of items
        held[r["gram"]] = r["count"]
    counts = spark.sparkContext.broadcast(held)
    ids = stage(hits.select("doc_id").distinct(), "seeded")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, common = sent.value, counts.value
        memory: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for part in batches:
            out = []
            for doc_id, text in zip(part["doc_id"].tolist(), part["text"].tolist()):
                ids = block.ids(text)
                spots: dict[int, list[tuple[int, int]]] = {}
                for at, gram in zip(*block.hits(ids)):
                    for key, place in block.places[gram]:
                        spots.setdefault(key, []).append((at - place, int(common[gram])))
                for key, begins in spots.items():
                    item_id, own = block.items[key]
                    slack = len(own) // 2 + 4
                    places: list[tuple[int, int]] = []  # documents that hold the rarest seed, begin
                    for b, count in sorted(begins):
                        if places and b - places[-1][1] < slack // 2:  # within the window of the spot before
                            places[-1] = (min(count, places[-1][0]), places[-1][1])
                        else:
                            places.append((count, b))
                    best, begin, end = 0, 0, 0
                    for _, b in sorted(places):
                        lo, hi = max(0, b - slack), min(len(ids), b + len(own) + slack + slack // 2)
                        window = ids[lo:hi]
                        name = (key, window.tobytes())
                        if name not in memory:
                            if _most(own, window) < max(best, least * 2 * len(own)):
                                continue
                            if len(memory) > 20_000:
                                memory.clear()
                            memory[name] = local_alignment(own, window)
                        score, x, y = memory[name]
                        if score > best or score == best and lo + x < begin:
                            best, begin, end = score, lo + x, lo + y
                    if best >= least * 2 * len(own):
                        out.append((doc_id, None if item_id is None else str(item_id), best / (2 * len(own)), len(begins), begin, end))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "n_seeds", "word_start", "word_end"])

    return map_rows(keep_ids(docs, ids, "doc_id"), align, RESULT, ("doc_id", "item_id"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 4,
    gapped: int = 48,
    least: float = 0.5,
    block_items: int = 20_000,
) -> DataFrame:
    """One row for each document and item whose alignment scores ``least`` or more.

    ``word_start`` and ``word_end`` bound the aligned words of the document.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    total = items.count()
    blocks = max(1, -(-total // block_items))
    out = None
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = _one_block(slim, [(r["i"], r["t"]) for r in mine.orderBy("i", "t").collect()], n, gapped, least)
        out = found if out is None else out.union(found)
    return out
