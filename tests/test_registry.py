"""The registry, split streams and exact routing against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions.xxh64 import xxh64
from stratalog.functions.xxh64_keys import hash_after
from stratalog.operators import log, registry, routing

LEASE = timedelta(hours=6)


def one_by_one(ops):
    held, out = {}, {}
    for node, at, seq, op in sorted(ops, key=lambda o: (o[1], o[2])):
        if op == "register":
            said, held[node] = "registered", at + LEASE
        elif op == "deregister":
            said = "deregistered"
            held.pop(node, None)
        elif node not in held:
            said = "missing"
        elif held[node] < at:
            said = "expired"
            held.pop(node)
        else:
            said, held[node] = "renewed", at + LEASE
        out[seq] = (said, held.get(node))
    return out, held


@pytest.mark.parametrize("seed", [1, 2])
def test_registry_against_a_dictionary(spark, seed):
    pick, begin = random.Random(seed), datetime(2024, 1, 1)
    kinds = ["register", "deregister", *["renew"] * 6]
    ops = [(pick.randrange(3), begin + timedelta(hours=pick.randrange(600)), i, pick.choice(kinds)) for i in range(300)]
    # a run of renewals over midnight, one on the expiry itself and one just after it
    at = begin + timedelta(days=40, hours=20)
    for seq, (after, op) in enumerate([(0, "register"), (5, "renew"), (11, "renew"), (17.001, "renew"), (18, "renew")], 1000):
        ops.append((7, at + timedelta(hours=after), seq, op))
    odd = [(None, begin, 2000, "register"), (1, None, 2001, "renew")]
    table = spark.createDataFrame([*ops, *odd], "node_id long, at timestamp_ntz, seq long, op string")
    done = registry.outcomes(table, "6 HOURS")
    expected, held = one_by_one(ops)
    assert {r["seq"]: (r["outcome"], r["expires_at"]) for r in done.collect()} == expected
    assert [expected[s][0] for s in range(1000, 1005)] == ["registered", "renewed", "renewed", "expired", "missing"]
    now = begin + timedelta(days=20)
    _, known = one_by_one([o for o in ops if o[1] <= now])
    got = registry.live(done, F.lit(now).cast("timestamp_ntz")).collect()
    assert {r["node_id"] for r in got} == {n for n, end in known.items() if end > now}
    assert registry.outcomes(table.where("false"), "6 HOURS").collect() == []


def test_changes_are_kept_until_they_are_taken(spark):
    days = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    live = spark.createDataFrame([(days[0], 1), (days[1], 2), (days[2], 1), (days[2], 3), (days[3], 3)], "poll_at timestamp_ntz, node_id long")
    polls = spark.createDataFrame(list(zip(days, [True, False, True, True])), "poll_at timestamp_ntz, delivered boolean")
    got = {(r["poll_at"].day, r["node_id"], r["change"]) for r in registry.published_changes(live, polls).collect()}
    assert got == {(1, 1, "registered"), (3, 3, "registered"), (4, 1, "deregistered")}


def test_offsets_of_split_streams(spark):
    pick = random.Random(3)
    rows = [(pick.choice([None, 1, 2]), pick.choice([None, *[datetime(2024, 1, d, h) for d in (1, 2, 3) for h in (0, 12)]]), i) for i in range(200)]
    events = spark.createDataFrame(rows, "stream_id long, ts timestamp_ntz, message_id long")
    order = ["ts", "message_id"]
    whole = {r["message_id"]: r["stream_offset"] for r in log.assign_offsets(events, "stream_id", order).collect()}
    split = log.assign_offsets(events, "stream_id", order, F.to_date("ts"))
    assert split.columns == [*events.columns, "stream_offset"]
    assert {r["message_id"]: r["stream_offset"] for r in split.collect()} == whole


def test_many_hashes_at_once():
    pick = np.random.default_rng(4)
    data = [pick.bytes(32) for _ in range(50)] + [bytes(32), b"\xff" * 32]
    for whole in data:
        keys = np.frombuffer(whole[16:], "<u8").reshape(1, 2)
        assert int(hash_after(whole[:16], keys)[0]) == xxh64(whole)


def test_exact_routing_keeps_other_columns(spark):
    big = (1 << 53) + 1
    rows = [(big, b"a" * 16), (None, b"b" * 16), (3, None)]
    nodes = [bytes([i]) * 16 for i in range(5)]
    got = routing.route_exact(spark.createDataFrame(rows, "id long, key binary"), nodes, "key").collect()
    assert [r["id"] for r in got] == [big, None, 3]
    assert [r["node_id"] and bytes(r["node_id"]) for r in got] == [max(nodes, key=lambda n: xxh64(n + k)) if k else None for _, k in rows]
