"""XXH64 with seed 0, as published by its author; Spark's own has seed 42."""

from __future__ import annotations

# Fixed values of the algorithm.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_M = (1 << 64) - 1


def _turn(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _round(acc: int, lane: int) -> int:
    return _turn((acc + lane * P2) & _M, 31) * P1 & _M


def xxh64(data: bytes, seed: int = 0) -> int:
    """The unsigned 64-bit hash of ``data``."""
    n, at = len(data), 0
    if n >= 32:
        lanes = [(seed + P1 + P2) & _M, (seed + P2) & _M, seed & _M, (seed - P1) & _M]
        while at + 32 <= n:
            lanes = [_round(a, int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")) for i, a in enumerate(lanes)]
            at += 32
        h = sum(_turn(a, r) for a, r in zip(lanes, (1, 7, 12, 18))) & _M
        for a in lanes:
            h = ((h ^ _round(0, a)) * P1 + P4) & _M
    else:
        h = (seed + P5) & _M
    h = (h + n) & _M
    while at + 8 <= n:
        h = (_turn(h ^ _round(0, int.from_bytes(data[at : at + 8], "little")), 27) * P1 + P4) & _M
        at += 8
    if at + 4 <= n:
        h = (_turn(h ^ (int.from_bytes(data[at : at + 4], "little") * P1 & _M), 23) * P2 + P3) & _M
        at += 4
    for byte in data[at:]:
        h = _turn(h ^ (byte * P5 & _M), 11) * P1 & _M
    for shift, p in ((33, P2), (29, P3), (32, 1)):
        h = ((h ^ (h >> shift)) * p) & _M
    return h
