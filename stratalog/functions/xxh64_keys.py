"""XXH64 with seed 0 of 32 bytes, for many keys at once in numpy."""

from __future__ import annotations

import numpy as np

from .xxh64 import P1, P2, P3, P4

_U = np.uint64
_STARTS = tuple(x % (1 << 64) for x in (P1 + P2, P2, 0, -P1))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _U(P2), 31) * _U(P1)


def hash_after(prefix: bytes, keys: np.ndarray) -> np.ndarray:
    """The hashes of 16 bytes followed by each row of ``keys``, two 64-bit little-endian lanes a row."""
    n = len(keys)
    head = np.frombuffer(prefix, "<u8")
    lanes = [np.full(n, head[0]), np.full(n, head[1]), keys[:, 0], keys[:, 1]]
    accs = [_round(np.full(n, start, _U), lane) for start, lane in zip(_STARTS, lanes)]
    h = _turn(accs[0], 1) + _turn(accs[1], 7) + _turn(accs[2], 12) + _turn(accs[3], 18)
    for acc in accs:
        h = (h ^ _round(np.zeros(n, _U), acc)) * _U(P1) + _U(P4)
    h = h + _U(32)
    for shift, p in ((33, P2), (29, P3)):
        h = (h ^ (h >> _U(shift))) * _U(p)
    return h ^ (h >> _U(32))
