"""Packing of token sequences by bounded-space online best-fit.

Documents are encoded, ended with an id, and cut into pieces only if they are
longer than a sequence. Only the pieces' lengths are then dealt to packers; a
packer takes its pieces in the order of a hash and keeps a fixed number of open
bins in a bitset keyed by free space. A piece goes to the open bin with the
least room that holds it. If none does and all places are taken, the fullest
bin closes. Runs of as many pieces as there are open bins are taken longest
first; were all of a packer's pieces, more long ones than open bins would close
most bins before the first short piece comes.

Defined cases: a null or empty text is one piece that holds the end id alone;
a repeated row is packed as often as it occurs, and so is a row without an id,
which stays null; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, stage
from .tokens import PieceCodec

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Bins of one size. ``place(length)`` gives ``(bin number, offset)``."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f is set if some open bin has room f
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.count = self.open = 0

    def _pop(self, room: int) -> tuple[int, int]:
        stack = self.at[room]
        out = stack.pop()
        if not stack:
            self.free &= ~(1 << room)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.size:
            raise ValueError(f"length {length} does not fit bins of {self.size}")
        fits = self.free >> length
        if fits:
            number, used = self._pop(length + (fits & -fits).bit_length() - 1)
        else:
            if self.open == self.open_bins:
                self._pop((self.free & -self.free).bit_length() - 1)
            number, used = self.count, 0
            self.count += 1
        if room := self.size - used - length:
            self.at.setdefault(room, []).append((number, used + length))
            self.free |= 1 << room
            self.open += 1
        return number, used


def piece_rows(
    batches: Iterator[pd.DataFrame], vocabulary: str, size: int, end_id: int, style: str, remember: int, block_chars: int
) -> Iterator[pd.DataFrame]:
    """The pieces of each batch of documents."""
    codec, end = PieceCodec.shared(vocabulary, style, remember, block_chars), end_id.to_bytes(4, "little")
    step = 4 * size
    for part in batches:
        out = []
        for doc_id, ids in zip(part["doc_id"].tolist(), codec.encode_many(part["text"].tolist())):
            ids += end
            for i, at in enumerate(range(0, len(ids), step)):
                cut = ids[at : at + step]
                out.append((doc_id, i, at >> 2, len(cut) >> 2, zlib.crc32(cut)))
        yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])


def encode_pieces(
    docs: DataFrame, vocabulary: str, size: int, end_id: int, id_col: str, text_col: str, style: str, remember: int, block_chars: int
) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return piece_rows(batches, vocabulary, size, end_id, style, remember, block_chars)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(slim, run, _PIECES)


def _runs(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in runs of ``rows``, wherever the batches end."""
    rest = None
    for part in batches:
        rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
        whole = len(rest) - len(rest) % rows
        for at in range(0, whole, rows):
            yield rest.iloc[at : at + rows]
        rest = rest.iloc[whole:]
    if rest is not None and len(rest):
        yield rest


def pack(pieces: DataFrame, size: int, open_bins: int, pieces_per_task: int = 65_536) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs a column ``length``."""
    n = max(1, -(-pieces.count() // pieces_per_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for part in _runs(batches, open_bins):
            part = part.sort_values("length", ascending=False, kind="stable")
            placed = np.array([fit.place(x) for x in part["length"].tolist()], dtype=np.int64).reshape(-1, 2)
            yield part.assign(sequence_id=placed[:, 0] + base, offset=placed[:, 1])

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(n, mixed).sortWithinPartitions(mixed, "doc_id", "piece", "ids_crc32")
    return map_rows(dealt, run, _PIECES + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    size: int = 2048,
    open_bins: int = 512,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    style: str = "words",
    remember: int = 450_000,
    block_chars: int = 6_000_000,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in a sequence.

    ``remember`` bounds the pieces of text that a worker keeps with their ids,
    at about 250 bytes each, and ``block_chars`` the characters whose pieces it
    looks up at once. Smaller values take less memory and more time.
    """
    bound_batches(docs.sparkSession, f"{min(16 << 20, 2 * block_chars)}b")
    pieces = stage(encode_pieces(docs, vocabulary, size, end_id, id_col, text_col, style, remember, block_chars), "pieces")
    return pack(pieces, size, open_bins)
