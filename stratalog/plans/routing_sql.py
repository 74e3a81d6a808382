"""Exact routing in SQL: XXH64 over 32 bytes, in 128-bit whole numbers modulo 2**64."""

from __future__ import annotations

from stratalog.functions.xxh64 import P1, P2, P3, P4


def _n(value: int) -> str:
    return f"CAST({value} AS UHUGEINT)"


_MOD = _n(1 << 64)


def _turn(x: str, r: int) -> str:
    return f"(({x} * {_n(1 << r)}) % {_MOD} + {x} // {_n(1 << (64 - r))})"


def _round(acc: int, lane: str) -> str:
    sum_ = f"(({_n(acc % (1 << 64))} + {lane} * {_n(P2)}) % {_MOD})"
    return f"({_turn(sum_, 31)} * {_n(P1)} % {_MOD})"


def _swapped(x: str) -> str:
    """A whole number's eight bytes, read from the other end."""
    return " + ".join(f"CAST(({x} // {256**i}) % 256 AS UHUGEINT) * {_n(256 ** (7 - i))}" for i in range(8))


def exact_routes(nodes: str, workloads: str) -> str:
    """``workload`` and ``node_id`` for SQL of ``nodes(node_id)`` and ``workloads(workload)``."""
    steps = [
        f"n AS (SELECT node_id, {_swapped('node_id')} AS m FROM ({nodes}))",
        f"w AS (SELECT workload, {_swapped('workload')} AS k FROM ({workloads}))",
        f"""h0 AS (SELECT workload, node_id, {_round(P1 + P2, _n(0))} AS a, {_round(P2, 'm')} AS b,
{_round(0, _n(0))} AS c, {_round(-P1, 'k')} AS d FROM w CROSS JOIN n)""",
        f"h1 AS (SELECT *, ({_turn('a', 1)} + {_turn('b', 7)} + {_turn('c', 12)} + {_turn('d', 18)}) % {_MOD} AS h FROM h0)",
    ]
    for i, lane in enumerate("abcd", 2):
        steps.append(f"h{i} AS (SELECT * REPLACE ((xor(h, {_round(0, lane)}) * {_n(P1)} + {_n(P4)}) % {_MOD} AS h) FROM h{i - 1})")
    steps.append(f"h6 AS (SELECT * REPLACE ((h + {_n(32)}) % {_MOD} AS h) FROM h5)")
    for i, (shift, p) in enumerate(((33, P2), (29, P3), (32, 1)), 7):
        steps.append(f"h{i} AS (SELECT * REPLACE (xor(h, h // {_n(1 << shift)}) * {_n(p)} % {_MOD} AS h) FROM h{i - 1})")
    steps.append("r AS (SELECT workload, node_id, row_number() OVER (PARTITION BY workload ORDER BY h DESC, node_id) AS rk FROM h9)")
    return "WITH " + ",\n".join(steps) + "\nSELECT workload, node_id FROM r WHERE rk = 1"
