"""Behaviour that the tables do not show: faults, ties, empty inputs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from stratalog.functions import attributes
from stratalog.functions.xxh64 import xxh64
from stratalog.operators import cluster, commands, log, metrics, routing, signals
from stratalog.sources import journal, schema
from stratalog.sources.tables import open_dsn
from stratalog.streaming.ingest import Ledger, project


@pytest.mark.parametrize(
    "data, value",
    [
        (bytes(32), 0xF6E9BE5D70632CF5),
        (bytes(range(32)), 0xCBF59C5116FF32B4),
        (b"0123456789abcdefABCDEFGHIJKLMNOP", 0x07FB3B235DFD1D66),
        (b"", 0xEF46DB3751D8E999),
    ],
)
def test_xxh64(data, value):
    assert xxh64(data) == value


def test_xxh64_agrees_with_the_library():
    import xxhash

    rng = random.Random(3)
    for n in range(100):
        data = rng.randbytes(n)
        assert xxh64(data) == xxhash.xxh64(data).intdigest()


@pytest.fixture(scope="module")
def work(spark):
    return spark.range(2000).withColumnRenamed("id", "workload")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id long")


def test_routing_properties(spark, work):
    ten = nodes_of(spark, range(10))
    first = {r[0]: r[1] for r in routing.route(work, ten, "workload", "node_id").collect()}
    assert set(first.values()) == set(range(10))
    assert first == {r[0]: r[1] for r in routing.route(work, ten, "workload", "node_id").collect()}
    less = {r[0]: r[1] for r in routing.route(work, ten.where("node_id <> 3"), "workload", "node_id").collect()}
    assert all(less[w] == n for w, n in first.items() if n != 3) and 3 not in less.values()
    with pytest.raises(ValueError):
        routing.route(work, nodes_of(spark, []), "workload", "node_id")


def test_routing_by_join_agrees(spark, work):
    ten = nodes_of(spark, range(10))
    a = {r[0]: r[1] for r in routing.route(work, ten, "workload", "node_id").collect()}
    b = {r["workload"]: r["node_id"] for r in routing.route(work, ten, "workload", "node_id", most=2).collect()}
    assert a == b


def test_exact_routing(spark):
    rng = random.Random(1)
    nodes, keys = [rng.randbytes(16) for _ in range(10)], [rng.randbytes(16) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    got = {bytes(r[0]): bytes(r[1]) for r in routing.route_exact(df, nodes, "key").collect()}
    assert got == {k: max(nodes, key=lambda n: xxh64(n + k)) for k in keys}


def test_append_answers(spark):
    records = spark.createDataFrame(
        [("s", 0, 0, 3, "a", 3), ("s", 1, 3, 4, "d", 1)], "stream_id string, pos long, offset_before long, offset_after long, first_message_id string, n_events long"
    )
    asked = spark.createDataFrame(
        [("s", "a", 3, 0), ("s", "a", 3, 2), ("s", "a", 3, 3), ("s", "b", 2, 0), ("s", "d", 1, 4)],
        "stream_id string, first_message_id string, n_events long, hint long",
    )
    got = {(r.first_message_id, r.begin_offset, r.end_offset, r.by_prior) for r in log.answer_appends(asked, records).collect()}
    # below the hint, not found; a batch that begins elsewhere is new
    assert got == {("a", 0, 3, True), ("a", 4, 7, False), ("b", 4, 6, False), ("d", 4, 5, False)}


def test_empty_append_is_refused(spark):
    bad = spark.createDataFrame([("s", 0)], "stream_id string, n_events long")
    with pytest.raises(Exception, match="at least one event"):
        log.require_events(bad).collect()


def record(op, pos, command, n=0):
    return ("h", pos, op, command, n)


ACC, HAN, APP = commands.OPERATIONS


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([], []),
        ([record(ACC, 0, "c")], [(2, "c", True)]),
        ([record(ACC, 0, "c"), record(HAN, 1, "c", 3)], [(1, "c", True)]),
        ([record(ACC, 0, "c"), record(HAN, 1, "c", 0)], [(1, "c", False)]),
        ([record(ACC, 0, "c"), record(HAN, 1, "c", 3), record(APP, 2, "c")], []),
        ([record(ACC, 0, "a"), record(ACC, 1, "b"), record(HAN, 2, "b", 1)], [(1, "b", True), (2, "a", True)]),
        ([record(ACC, 0, "a"), record(ACC, 1, "b"), record(HAN, 2, "a", 1), record(APP, 3, "a")], [(2, "b", True)]),
    ],
)
def test_recovery_at_each_cut(spark, rows, expected):
    df = spark.createDataFrame(rows, "handler_key string, pos long, op string, command_id string, n_events long")
    assert [(r.phase, r.command_id, r.effective) for r in commands.recover(df).collect()] == expected


def test_acceptance_outlives_the_journal(spark):
    pushes = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "command_id string, attempt int")
    before = spark.createDataFrame([("b",)], "command_id string")
    got = {(r.command_id, r.attempt): r.outcome for r in commands.accept(pushes, "command_id", ["attempt"], before).collect()}
    assert got == {("a", 0): "accepted", ("a", 1): "ignored_duplicate", ("b", 0): "ignored_duplicate"}


def test_hints_start_at_the_tail(spark):
    df = spark.createDataFrame([("s", 0, 1), ("s", 1, 1)], "stream_id string, pos long, n_events long")
    got = commands.offset_hints(df, "stream_id", ["pos"], F.lit(10)).orderBy("pos").collect()
    assert [r.offset_hint for r in got] == [10, 11]


def test_handler_and_sticky_stream(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "command_id long, n long")
    got = commands.handle(df, lambda c: [{"k": i} for i in range(c["n"])], "command_id", "k long").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 1, 1), (3, 0, 0)]
    streams = spark.createDataFrame([("h", 0, "x"), ("h", 1, "y")], "handler string, pos long, stream string")
    assert {r.stream for r in commands.sticky_stream(streams, "handler", ["pos"], "stream").collect()} == {"x"}


def test_union_dispatch(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(commands.switch_operation({"a": F.lit("A"), "b": F.lit("B")})).collect()] == ["A", "B"]
    with pytest.raises(Exception, match="no operation"):
        spark.createDataFrame([(None, None)], "a int, b int").select(commands.switch_operation({"a": F.lit("A"), "b": F.lit("B")})).collect()
    with pytest.raises(Exception, match="no route"):
        commands.by_media_type(spark.createDataFrame([("x",)], "media_type string"), {"y": "h"}).collect()


def test_schemas_parse():
    assert schema.struct(schema.COMMAND_RECORD).names[2] == "op"
    assert schema.struct(schema.STREAM_RECORD)["events"].dataType.elementType.names[0] == "message_id"
    assert schema.struct(schema.REGISTRATION).names == ["node", "expires_at"]


@pytest.mark.parametrize(
    "now, live", [("00:00:05", [("n", True)]), ("00:00:20", []), ("00:00:19", [("n", True)])]
)
def test_lease_ends_when_it_says(spark, now, live):
    beats = cluster.heartbeats(spark.sql("SELECT 'n' node_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' ts"), "20 SECONDS")
    got = cluster.live_nodes(beats, F.lit(f"2024-01-01 {now}").cast("timestamp_ntz")).collect()
    assert [(r.node_id, True) for r in got] == live


def test_lease_renewed_on_the_expiry_and_over_midnight(spark):
    rows = [("n", "2023-12-31 23:59:50", 1), ("n", "2024-01-01 00:00:10", 2), ("n", "2024-01-01 00:00:31", 3)]
    df = spark.createDataFrame(rows, "node_id string, t string, event_id long").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    got = cluster.leases(cluster.heartbeats(df, "20 SECONDS"), ["ts", "event_id"]).orderBy("lease_no").collect()
    assert [(r.lease_no, r.renewals) for r in got] == [(1, 2), (2, 1)]


def test_journal_positions_are_checked(spark, tmp_path):
    j = journal.Journal(spark, f"file://{tmp_path}/j", "stream_id string, pos bigint, v string")
    rows = lambda *x: spark.createDataFrame(list(x), "stream_id string, pos bigint, v string")
    assert j.read().count() == 0
    j.append(rows(("s", 0, "a"), ("s", 1, "b")), 0)
    j.append(rows(("s", 2, "c"), ("t", 0, "x")), 1)
    j.append(rows(("s", 2, "c"), ("t", 0, "x")), 1)  # again
    with pytest.raises(journal.Conflict):
        j.append(rows(("s", 2, "d")), 2)
    with pytest.raises(journal.Conflict):
        j.append(rows(("t", 2, "d")), 2)
    assert sorted(map(tuple, j.bounds().collect())) == [("s", 0, 3), ("t", 0, 1)]
    assert [r.v for r in j.scan(1, 3).collect() if r.stream_id == "s"] == ["b", "c"]
    assert sorted((r.stream_id, r.v) for r in j.last().collect()) == [("s", "c"), ("t", "x")]
    assert j.truncated(2).count() == 1
    assert journal.journal_name("eventstream", "k") == "eventstream:k"


def test_keyspace_and_dense_positions(spark):
    df = spark.createDataFrame([("a", "1", 0), ("a", None, 1), ("b", "1", 0), ("b", "2", 1)], "k string, v string, version int")
    assert [tuple(r) for r in journal.latest_by_key(df, "k", "v", "version").collect()] == [("b", "2")]
    tails = spark.createDataFrame([("a", 5)], "k string, tail long")
    got = journal.dense_positions(df, "k", ["version"], tails).collect()
    assert sorted((r.k, r.pos) for r in got) == [("a", 5), ("a", 6), ("b", 0), ("b", 1)]


def test_open_dsn(spark, tmp_path):
    spark.range(3).write.json(f"{tmp_path}/j")
    assert open_dsn(spark, f"json+file://{tmp_path}/j").count() == 3
    with pytest.raises(ValueError):
        open_dsn(spark, "jdbc:postgresql://host/db")


@pytest.mark.parametrize("seed", range(3))
def test_ordered_set_against_a_set(spark, seed):
    rng, model, ops = random.Random(seed), set(), []
    for i in range(400):
        m, add = rng.randrange(-128, 128), rng.random() < 0.6
        ops.append((m, "add" if add else "delete", i))
        (model.add if add else model.discard)(m)
    df = spark.createDataFrame(ops, "m long, op string, i long")
    got = signals.ordered_set(signals.last_operation_wins(df, "m", "op", ["i"], "add", "delete")).orderBy("idx").collect()
    assert [(r.member, r.idx) for r in got] == [(m, i) for i, m in enumerate(sorted(model))]


def test_ordered_set_of_nothing(spark):
    assert signals.ordered_set(spark.createDataFrame([], "member long")).collect() == []


def test_fan_out_bounds(spark):
    t = lambda s: f"2024-01-0{s} 12:00:00"
    subs = spark.createDataFrame([(t(1), t(3)), (t(2), t(2))], "a string, b string").select(
        F.col("a").cast("timestamp_ntz").alias("sub_at"), F.col("b").cast("timestamp_ntz").alias("unsub_at")
    )
    pubs = spark.createDataFrame([(1, t(1)), (2, t(2)), (3, t(3)), (4, t(4))], "event_id long, t string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert sorted(map(tuple, signals.fan_out(pubs, subs).collect())) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_attributes(spark):
    rows = spark.sql("SELECT unhex(repeat('ab', 70)) b, TIMESTAMP '2000-01-01 00:00:00' t, CAST(NULL AS STRING) n")
    got = rows.select(
        attributes.attribute_map(
            attributes.binary("b", F.col("b")), attributes.time("t", F.col("t")), attributes.string("n", F.col("n")),
            attributes.duration("d", F.lit(1_500_000)), attributes.double("x", F.lit(0.5)), attributes.string("x", F.lit("last")),
        )
    ).first()[0]
    assert got == {"b_truncated": "ab" * 64, "t": "2000-01-01T00:00:00.000000Z", "d": "1.500000", "x": "last"}


def test_counter_and_spans(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "k string, v long")
    assert sorted(map(tuple, metrics.counter(df, ["k"], F.col("v")).collect())) == [("a", 5), ("b", 1)]


class Crash(RuntimeError):
    pass


def test_ledger_survives_faults(spark, tmp_path):
    """Overlapping files, a failure before a write and one after it."""
    rows = [(i % 7, i) for i in range(200)]
    for k in range(4):
        part = rows[max(0, 50 * k - 15) : 50 * k + 50]
        spark.createDataFrame(part, "stream_id long, message_id long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = lambda: (
        spark.readStream.schema("stream_id long, message_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    )
    ledger = Ledger(spark, f"file://{tmp_path}/out", "stream_id", "message_id", ["message_id"], "stream_id bigint, message_id bigint")
    checkpoint = f"{tmp_path}/cp-{uuid.uuid4().hex}"
    done = set()

    def early(batch_id):
        if batch_id == 1 and "early" not in done:
            done.add("early")
            raise Crash

    write = ledger.write_batch

    def late(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 2 and "late" not in done:
            done.add("late")
            raise Crash

    ledger.write_batch = late
    for _ in range(3):
        run = ledger.ingest(source(), checkpoint, early)
        try:
            run.awaitTermination()
            break
        except Exception:  # noqa: BLE001
            continue
    assert done == {"early", "late"}
    got = ledger.read().collect()
    assert len(got) == len({r.message_id for r in got}) == 200
    for s in range(7):
        mine = sorted(r.stream_offset for r in got if r.stream_id == s)
        assert mine == list(range(len(mine)))
    count = lambda df: df.groupBy(F.col("stream_id").alias("key")).agg(F.count("*").alias("value"))
    state, applied = project(ledger, count, None, None)
    again, _ = project(ledger, count, state, applied)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, again.collect()))
