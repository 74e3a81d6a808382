"""Elias-Fano coding of a sorted sequence of offsets."""

from __future__ import annotations

import numpy as np

_SAMPLE = 64


class EliasFano:
    """Non-decreasing ``values`` in ``[0, universe]``, about 2 + log2(universe / n) bits each.

    The low bits are packed; the high parts are a unary bit string, in which
    the position of the i-th one, less i, is the high part of value i. Every
    64th one's position is kept, so that ``select`` scans a few bytes.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values, universe: int) -> "EliasFano":
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        if n and (v[0] < 0 or v[-1] > universe or (np.diff(v) < 0).any()):
            raise ValueError("values must be sorted within the universe")
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.packbits((v[:, None] >> np.arange(width)) & 1 if width else np.zeros(0, np.int64)).tobytes() if n else b""
        ones = (v >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits).tobytes(), ones[::_SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        at = i * self.width
        part = np.unpackbits(np.frombuffer(self.low, np.uint8, (at + self.width + 7) // 8 - at // 8, at // 8))
        bits = part[at % 8 : at % 8 + self.width].astype(np.int64)
        return int((bits << np.arange(self.width)).sum())

    def select(self, i: int) -> int:
        """Value ``i``, from one sample and the bytes after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // _SAMPLE])
        left, byte = i % _SAMPLE, at // 8
        high = np.frombuffer(self.high, np.uint8)
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(high[byte : byte + 64])[skip:])
            if left < len(ones):
                return ((byte * 8 + skip + int(ones[left]) - i) << self.width) | self._low(i)
            left, byte, skip = left - len(ones), byte + 64, 0

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.width
        if self.width and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8))[: self.n * self.width].reshape(self.n, self.width)
            out |= (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out
