"""Exact token counts of every prefix, by dynamic programming over the merges.

The last token of a prefix is the one vocabulary entry that ends there and can
follow the last token of the prefix before it (two tokens can stand together
if encoding their joined bytes gives the same two). So one pass over a
pre-token gives the count of each of its prefixes. Pre-tokens repeat, and what
is found for a piece of text is remembered, within a bound, by each worker.

Defined cases: a null or empty text has no bytes and no tokens; a special
string counts as one token; repeated rows are counted alike; a null id is
passed on; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows
from .tokens import _MARKS, PieceCodec, blocks, byte_symbols, shrink, split_unique

_COUNTERS: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Counts for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, limit: int = 800_000):
        self.codec, self.limit = PieceCodec(path, "spaced"), limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = {c: b for b, c in byte_symbols().items()}
        raw = lambda s: bytes(symbols[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: Single bytes, then what the merges make, in their order.
        self.order = {bytes([i]): i for i in range(256)}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            pair = self.order[raw(a)], self.order[raw(b)]
            made = self.order.setdefault(raw(a + b), 256 + len(self.joined))
            self.joined[pair] = made
            self.halves.setdefault(made, pair)
        self.longest = max(map(len, self.order))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self.totals: dict[str, int] = {}

    @classmethod
    def shared(cls, path: str) -> "PrefixCounter":
        if path not in _COUNTERS:
            _COUNTERS[path] = cls(path)
        return _COUNTERS[path]

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay as they are when joined.

        They would not if, at some moment of their making, the piece that then
        ends ``a`` and the piece that then begins ``b`` had an earlier merge.
        Going back in time, the younger of the two is undone.
        """
        key = (a, b)
        found = self.pairs.get(key)
        if found is not None:
            return found
        before = 1 << 30  # merges from here on come too late to matter
        while True:
            if self.joined.get((a, b), before) < before:
                found = False
                break
            if a > b:
                before, parts = a, self.halves.get(a)
                if parts:
                    a = parts[1]
                    continue
            else:
                before, parts = b + 1, self.halves.get(b)
                if parts:
                    b = parts[0]
                    continue
            found = True  # the younger is a single byte, and so is the other
            break
        if len(self.pairs) > 4 * self.limit:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Counts of the prefixes of one pre-token: entry i is that of ``data[:i]``."""
        counts, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        order, longest = self.order, self.longest
        for end in range(1, len(data) + 1):
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = order.get(data[start:end])
                if token is not None and (not start or self._can_follow(last[start], token)):
                    counts[end], last[end] = counts[start] + 1, token
                    break
        return counts

    def _segments(self, text: str) -> list[str]:
        parts = [text]
        for s in self.special:
            parts = [x for p in parts for x in ([p] if p in self.special else _split_keeping(p, s))]
        return [p for p in parts if p]

    def _word_total(self, word: str) -> int:
        """Tokens of one pre-token: the count of its longest prefix."""
        n = self.words.get(word)
        if n is None:
            if len(self.words) > self.limit:
                shrink(self.words)
            n = self.words[word] = self.byte_prefixes(word.encode())[-1]
        return n

    def piece_total(self, piece: str) -> int:
        """Tokens of a piece as it stands."""
        body = piece[1:] if piece[:1] == " " else piece
        if not piece:
            return 0
        if piece[0] == "\n" and piece[1:2] not in ("", "\n"):
            return 1 + self.piece_total(piece[1:])  # a single line break is a token run of its own
        if body.isalpha():
            return self._word_total(piece)
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return self._word_total(piece[:-1]) + self._word_total(piece[-1])
        cut = self.codec.tokenizer.pre_tokenizer.pre_tokenize_str
        return sum([self._word_total(piece[a:b]) for _, (a, b) in cut(piece)])

    def pieces(self, text: str) -> list[str] | None:
        """Stretches that no token crosses, or None if only the whole text tells."""
        cut = self.codec.pieces(text)
        return None if cut is None else cut[:1] + [p if p[:1] == "\n" else " " + p for p in cut[1:]]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return self.count_many([text])[0]

    def count_many(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, summed over its pieces; each distinct piece of a block is asked for once."""
        out: list[int] = []
        for block in blocks(texts):
            flat = [self.codec.spread(t) if t else "" for t in block]
            names, codes, ends = split_unique(flat)
            got = list(map(self.totals.get, names))
            for i, n in enumerate(got):
                if n is None:
                    got[i] = self.follower_total(names[i])
            summed = np.concatenate([[0], np.cumsum(np.array(got, dtype=np.int64)[codes])])
            for text, row, a, b in zip(block, flat, ends, ends[1:]):
                if row is None:
                    out.append(sum(1 if p in self.special else self._long_total(p) for p in self._segments(text)))
                else:
                    # the first piece has no space before it
                    out.append(int(summed[b] - summed[a + 1]) + self.piece_total(names[codes[a]]) if row else 0)
        return out

    def follower_total(self, piece: str) -> int:
        """Tokens of a piece that another comes before."""
        n = self.totals.get(piece)
        if n is None:
            if len(self.totals) > self.limit:
                shrink(self.totals)
            n = self.totals[piece] = self.piece_total(piece if piece[:1] == "\n" else " " + piece)
        return n

    def _long_total(self, text: str) -> int:
        cut = self.codec.tokenizer.pre_tokenizer.pre_tokenize_str
        return sum(self.piece_total(text[a:b]) for _, (a, b) in cut(text))

    def prefixes(self, text: str | None) -> np.ndarray:
        """Entry i is the token count of the first i characters as a text of their own."""
        text = text or ""
        out, done, at = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
        if any(s in text for s in self.special) or self.pieces(text) is None:
            return np.array([self.count(text[:i]) for i in range(len(text) + 1)])
        for p in self.pieces(text):
            for i in range(1, len(p) + 1):
                out[at + i] = done + self.piece_total(p[:i])
            at += len(p)
            done = int(out[at])
        return out

    def _cut_piece(self, piece: str, budget: int) -> int:
        """Characters of the longest prefix of a piece with at most ``budget`` tokens."""
        used = best = 0
        for _, (at, end) in self.codec.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
            word = piece[at:end]
            n = self._word_total(word)
            if used + n > budget:
                if len(word) <= 8:  # a mark and letters may be cut in two where they are cut short
                    fits = [i for i in range(1, len(word)) if used + self.piece_total(word[:i]) <= budget]
                else:
                    counts, ends = self.byte_prefixes(word.encode()), np.cumsum([len(c.encode()) for c in word])
                    fits = [i + 1 for i, e in enumerate(ends.tolist()) if used + counts[e] <= budget]
                return max([best] + [at + i for i in fits])
            used, best = used + n, end
        return best

    def cut_at(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens, piece by piece."""
        text = text or ""
        pieces = self.pieces(text)
        if pieces is None:
            low, high = 0, len(text)
            if self.count(text) <= budget:
                return high
            while high - low > 1:  # a longer text has a token more or less at its end; then settle exactly
                mid = (low + high) // 2
                low, high = (mid, high) if self.count(text[:mid]) <= budget else (low, mid)
            return low
        used = at = 0
        best = 0
        for p in pieces:
            n = self.piece_total(p)
            if used + n > budget:
                return max(best, at + self._cut_piece(p, budget - used))
            used, at = used + n, at + len(p)
            best = at
        return at


def _split_keeping(text: str, mark: str) -> list[str]:
    out: list[str] = []
    for i, p in enumerate(text.split(mark)):
        out += [mark, p] if i else [p]
    return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, limit_chars`` for every row.

    ``limit_chars`` is the length of the longest prefix within ``limit``
    tokens, which truncates without encoding again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter.shared(vocabulary)
        for part in batches:
            texts = part["text"].tolist()
            n = counter.count_many(texts)
            chars = [counter.cut_at(t, limit) if x > limit else len(t or "") for t, x in zip(texts, n)]
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"],
                    "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                    "n_tokens": n,
                    "over_limit": [x > limit for x in n],
                    "limit_chars": chars,
                }
            )

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(slim, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
