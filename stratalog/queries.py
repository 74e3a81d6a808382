"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import attributes
from stratalog.operators import cluster, commands, log, metrics, registry, routing, signals
from stratalog.plans import views
from stratalog.plans.oracles import HEARTBEATS, RECORDS
from stratalog.plans.oracles import ORACLES as _SPECIFIED
from stratalog.plans.routing_sql import exact_routes
from stratalog.sources import journal
from stratalog.sources.shared import shared_dir
from stratalog.sources.tables import table
from stratalog.streaming.ingest import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(_SPECIFIED)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# event streams


@query
def stream_offsets(spark, sf_dir):
    return views.stream(spark, sf_dir).select("stream_id", "stream_offset", "message_id")


@query
def stream_scan_range(spark, sf_dir):
    return log.scan_range(stream_offsets(spark, sf_dir), 10, 20)


@query
def append_records(spark, sf_dir):
    return views.records(spark, sf_dir)


@query
def journal_bounds(spark, sf_dir):
    return log.bounds(views.records(spark, sf_dir))


@query
def journal_last_record(spark, sf_dir):
    last = journal.last_record(views.records(spark, sf_dir), "stream_id", "pos")
    return last.select("stream_id", "pos", "offset_before", "offset_after")


@query
def search_by_offset(spark, sf_dir):
    found = log.search_by_offset(views.records(spark, sf_dir), 5)
    return found.select("stream_id", "pos", "offset_before", "offset_after")


@query
def append_contiguity(spark, sf_dir):
    return log.contiguity(views.records(spark, sf_dir))


@query
def append_dedup(spark, sf_dir):
    """The third batch of each stream, retried once as it was and once with new ids."""
    records = views.records(spark, sf_dir)
    both = F.array(
        F.struct(F.col("first_message_id").alias("first_message_id"), F.col("offset_before").alias("hint")),
        F.struct((F.col("first_message_id") + 1_000_000).alias("first_message_id"), F.col("offset_after").alias("hint")),
    )
    asked = records.where("pos = 2").select("stream_id", "n_events", F.explode(both).alias("x"))
    requests = log.require_events(asked.select("stream_id", "x.first_message_id", "n_events", "x.hint"))
    return log.answer_appends(requests, records)


# commands


@query
def recover_unhandled(spark, sf_dir):
    return commands.unhandled(views.accepted(spark, sf_dir), views.handled(spark, sf_dir))


@query
def recover_unappended(spark, sf_dir):
    return commands.unappended(views.handled(spark, sf_dir), views.appended(spark, sf_dir))


@query
def recover_summary(spark, sf_dir):
    return commands.recovery_summary(views.accepted(spark, sf_dir), views.handled(spark, sf_dir), views.appended(spark, sf_dir))


@query
def recover_order(spark, sf_dir):
    """What to finish, with its place in each handler's queue."""
    ids = views.accepted(spark, sf_dir)
    parts = (
        ("command_accepted", ids.withColumn("n_events", F.lit(0).cast("long"))),
        ("command_handled", ids.join(views.handled(spark, sf_dir), "command_id")),
        ("events_appended_to_stream", ids.join(views.appended(spark, sf_dir), "command_id").withColumn("n_events", F.lit(0).cast("long"))),
    )
    rows = None
    for op, part in parts:
        part = part.select(F.col("handler").alias("handler_key"), F.col("command_id").alias("pos"), F.lit(op).alias("op"), "command_id", "n_events")
        rows = part if rows is None else rows.union(part)
    return commands.recover(rows).select("handler_key", "phase", "command_id", "effective")


ORACLES["recover_order"] = f"""
WITH {_SPECIFIED["recover_unhandled"].split("WITH", 1)[1].split(") SELECT command_id, handler")[0]})
SELECT a.handler AS handler_key, 1 AS phase, h.command_id, h.n_events > 0 AS effective
FROM han h JOIN acc a ON a.command_id = h.command_id
WHERE NOT EXISTS (SELECT 1 FROM app p WHERE p.command_id = h.command_id)
UNION ALL
SELECT a.handler, 2, a.command_id, TRUE FROM acc a WHERE NOT EXISTS (SELECT 1 FROM han h WHERE h.command_id = a.command_id)
"""


@query
def accept_idempotent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("command_id"), F.lit(0).alias("attempt"))
    again = orders.where("command_id % 7 = 0").withColumn("attempt", F.lit(1))
    return commands.accept(orders.union(again), "command_id", ["attempt"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def record_events(spark, sf_dir):
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    lines = commands.ordinals(table(spark, sf_dir, "lineitem"), "l_orderkey", order)
    return lines.select(F.col("l_orderkey").alias("causation_id"), "ordinal", "l_partkey", "l_suppkey")


@query
def offset_hints(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("command_id"), F.col("o_orderdate").alias("created_at")
    )
    handled = orders.join(views.handled(spark, sf_dir).where("n_events > 0"), "command_id")
    hinted = commands.offset_hints(handled, "stream_id", ["created_at", "command_id"])
    return hinted.select("stream_id", "command_id", "offset_hint", "n_events")


@query
def sticky_streams(spark, sf_dir):
    """The one stream that each handler's commands go to."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_custkey")
    # the first command of a handler decides for all; a grouped minimum finds it map-side
    first = orders.groupBy(F.col("o_orderpriority").alias("handler")).agg(F.min_by("o_custkey", "at").alias("stream_id"), F.count("*").alias("n_commands"))
    return first


ORACLES["sticky_streams"] = """
WITH x AS (SELECT o_orderpriority AS handler, o_custkey,
CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rk FROM orders)
SELECT handler, MAX(CASE WHEN rk = 1 THEN o_custkey END) AS stream_id, COUNT(*) AS n_commands FROM x GROUP BY handler
"""


@query
def causation_lineage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("causation_id"), F.col("l_returnflag").alias("event_type"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("causation_id"), F.col("o_custkey").alias("correlation_id"))
    return commands.lineage(lines, orders, "causation_id", "correlation_id", "event_type")


@query
def envelope_pack(spark, sf_dir):
    """Orders as command envelopes, and each line as an event envelope caused by its order."""
    order = commands.envelope(
        F.col("o_orderkey"), F.to_json(F.struct("o_totalprice")), F.col("o_orderdate").cast("timestamp"), F.lit("place order"),
        F.lit("application/json"), ("shop", "1"),
    )
    packed = table(spark, sf_dir, "orders").select("o_orderkey", order.alias("command"))
    lines = views.event_counts(spark, sf_dir).join(packed, F.col("command_id") == F.col("o_orderkey"))
    event = commands.envelope(
        F.concat(F.col("command_id").cast("string"), F.lit("-e")), F.to_json(F.struct("n_events")), F.col("command.created_at"),
        F.lit("lines recorded"), F.lit("application/json"), ("shop", "1"), ("lines", "2"), F.col("command"),
    )
    done = lines.select(event.alias("e"))
    n = commands.unpack(F.col("e"), "n_events bigint")["n_events"]
    return done.select("e.message_id", "e.causation_id", "e.correlation_id", "e.media_type", n.alias("n_events"))


ORACLES["envelope_pack"] = """
SELECT CONCAT(CAST(l_orderkey AS VARCHAR), '-e') AS message_id, CAST(l_orderkey AS VARCHAR) AS causation_id,
CAST(l_orderkey AS VARCHAR) AS correlation_id, 'application/json' AS media_type, COUNT(*) AS n_events
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey
"""


@query
def media_type_routing(spark, sf_dir):
    """Events counted by the handler that their type is routed to."""
    routes = {"signup": "accounts", "error": "operations", "click": "web", "view": "web", "purchase": "sales"}
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("media_type"))
    return commands.by_media_type(events, routes).groupBy("handler").agg(F.count("*").alias("n"))


ORACLES["media_type_routing"] = """
SELECT CASE event_type WHEN 'signup' THEN 'accounts' WHEN 'error' THEN 'operations' WHEN 'purchase' THEN 'sales' ELSE 'web' END
AS handler, COUNT(*) AS n FROM events GROUP BY 1
"""


# keyspaces and sets


@query
def keyspace_latest(spark, sf_dir):
    """Users' last values; an error deletes the key."""
    return journal.latest_by_key(views.keyspace_writes(spark, sf_dir), "user_id", "value", "v")


ORACLES["keyspace_latest"] = """
WITH x AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS rk
FROM events) SELECT user_id, event_type AS value FROM x WHERE rk = 1 AND event_type <> 'error'
"""


@query
def set_membership(spark, sf_dir):
    """Customers with and without an accepted order."""
    known = journal.members(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    inside = journal.has(customers, known, "c_custkey").withColumn("is_member", F.lit(True))
    return inside.union(journal.has_not(customers, known, "c_custkey").withColumn("is_member", F.lit(False)))


ORACLES["set_membership"] = """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS is_member FROM customer
"""


@query
def keyspace_get(spark, sf_dir):
    """The values of all customers' keys, most of which users wrote or nobody did."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return journal.get(views.keyspace_writes(spark, sf_dir), keys, "user_id", "value", "v")


ORACLES["keyspace_get"] = f"""
WITH k AS ({_SPECIFIED["keyspace_latest"] if "keyspace_latest" in _SPECIFIED else ORACLES["keyspace_latest"]})
SELECT c.c_custkey AS user_id, k.value FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN k ON k.user_id = c.c_custkey
"""


@query
def journal_truncated(spark, sf_dir):
    """Bounds of each journal whose first two records are gone."""
    return log.bounds(journal.truncate(views.records(spark, sf_dir), 2))


ORACLES["journal_truncated"] = f"""
WITH {RECORDS} SELECT stream_id, MIN(pos) AS begin_pos, MAX(pos) + 1 AS end_pos, MAX(offset_after) AS next_offset
FROM r WHERE pos >= 2 GROUP BY stream_id
"""


@query
def union_dispatch(spark, sf_dir):
    """Orders as a union of open, part and full ones; each case gives a value of its own."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    cases = {"accepted": "O", "handled": "P", "appended": "F"}
    record = table(spark, sf_dir, "orders").select(key, *[F.when(status == s, F.struct(key.alias("command_id"))).alias(n) for n, s in cases.items()])
    value = commands.switch_operation({n: F.concat(F.lit(n + ":"), F.col(n)["command_id"].cast("string")) for n in cases})
    return record.select("o_orderkey", value.alias("operation"))


ORACLES["union_dispatch"] = """
SELECT o_orderkey, CONCAT(CASE o_orderstatus WHEN 'O' THEN 'accepted:' WHEN 'P' THEN 'handled:' WHEN 'F' THEN 'appended:' END,
CAST(o_orderkey AS VARCHAR)) AS operation FROM orders
"""


# cluster


@query
def registry_outcomes(spark, sf_dir):
    """What each registration, renewal and deregistration gives."""
    return registry.outcomes(views.registry_operations(spark, sf_dir), views.LEASE)


_OUTCOMES = """
o AS (SELECT user_id % 20 AS node_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'register'
WHEN 'error' THEN 'deregister' ELSE 'renew' END AS op FROM events),
f AS (SELECT *, CASE WHEN op <> 'renew' OR COALESCE(lag(ts) OVER w + INTERVAL 6 HOURS < ts, TRUE) THEN 1 ELSE 0 END AS fresh
FROM o WINDOW w AS (PARTITION BY node_id ORDER BY ts, seq)),
g AS (SELECT *, SUM(fresh) OVER (PARTITION BY node_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM f),
i AS (SELECT *, first_value(op) OVER (PARTITION BY node_id, run ORDER BY ts, seq) AS head FROM g),
b AS (SELECT *, lag(head) OVER (PARTITION BY node_id ORDER BY ts, seq) AS head_before FROM i),
done AS (SELECT node_id, ts, seq, op, CASE WHEN op = 'register' THEN 'registered' WHEN op = 'deregister' THEN 'deregistered'
WHEN fresh = 0 AND head = 'register' THEN 'renewed' WHEN fresh = 1 AND head_before = 'register' THEN 'expired' ELSE 'missing' END AS outcome
FROM b),
q AS (SELECT node_id, ts AS "at", seq, op, outcome, CASE WHEN outcome IN ('registered', 'renewed') THEN ts + INTERVAL 6 HOURS END AS expires_at FROM done)"""
ORACLES["registry_outcomes"] = f"WITH {_OUTCOMES} SELECT * FROM q"


@query
def registry_tombstones(spark, sf_dir):
    """Live nodes where a deregistration or a failed renewal ends a lease early."""
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return registry.live(registry_outcomes(spark, sf_dir), now)


ORACLES["registry_tombstones"] = f"""
WITH {_OUTCOMES}, l AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY "at" DESC, seq DESC) AS rk FROM q
WHERE "at" <= TIMESTAMP '2024-01-10 00:00:00')
SELECT node_id, expires_at FROM l WHERE rk = 1 AND expires_at > TIMESTAMP '2024-01-10 00:00:00'
"""


@query
def membership_published(spark, sf_dir):
    """Changes where nobody takes what is found on every third day of a month."""
    polls = views.polls(spark, sf_dir)
    live = cluster.live_at_polls(views.heartbeats(spark, sf_dir), polls)
    return registry.published_changes(live, polls.withColumn("delivered", F.dayofmonth("poll_at") % 3 != 0))


ORACLES["membership_published"] = f"""
WITH {HEARTBEATS}, sent AS (SELECT t, row_number() OVER (ORDER BY t) AS no FROM (SELECT DISTINCT date_trunc('day', ts) AS t FROM events)
WHERE day(t) % 3 <> 0),
live AS (SELECT DISTINCT s.no, h.node_id FROM sent s JOIN h ON h.ts <= s.t AND h.expires_at > s.t),
x AS (SELECT no, node_id, 'registered' AS change FROM live c WHERE NOT EXISTS
(SELECT 1 FROM live p WHERE p.no = c.no - 1 AND p.node_id = c.node_id)
UNION ALL SELECT no + 1, node_id, 'deregistered' FROM live p WHERE NOT EXISTS
(SELECT 1 FROM live c WHERE c.no = p.no + 1 AND c.node_id = p.node_id))
SELECT s.t AS poll_at, x.node_id, x.change FROM x JOIN sent s ON s.no = x.no
"""


@query
def registry_live(spark, sf_dir):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return cluster.live_nodes(views.heartbeats(spark, sf_dir), now)


@query
def registry_leases(spark, sf_dir):
    return cluster.leases(views.heartbeats(spark, sf_dir), ["ts", "event_id"])


@query
def membership_changed(spark, sf_dir):
    polls = views.polls(spark, sf_dir)
    return cluster.membership_changes(cluster.live_at_polls(views.heartbeats(spark, sf_dir), polls), polls)


@query
def rendezvous_route(spark, sf_dir):
    return routing.route(views.workloads(spark, sf_dir), views.nodes(spark, sf_dir), "workload", "node_id")


@query
def rendezvous_balance(spark, sf_dir):
    return routing.balance(rendezvous_route(spark, sf_dir))


@query
def rendezvous_remove_node(spark, sf_dir):
    work, nodes = views.workloads(spark, sf_dir), views.nodes(spark, sf_dir)
    before = routing.route(work, nodes, "workload", "node_id")
    after = routing.route(work, nodes.where("node_id <> 3"), "workload", "node_id")
    return routing.moved(before, after, "workload")


@query
def rendezvous_exact(spark, sf_dir):
    """Routing of 16-byte keys by the seed-0 hash."""
    nodes = [n.to_bytes(16, "big") for n in routing.node_list(views.nodes(spark, sf_dir), "node_id", 1000)]
    key = F.unhex(F.lpad(F.hex("workload"), 32, "0"))
    work = views.workloads(spark, sf_dir).select("workload", key.alias("key"))
    routed = routing.route_exact(work, nodes, "key")
    return routed.select("workload", F.conv(F.hex("node_id"), 16, 10).cast("long").alias("node_id"))


ORACLES["rendezvous_exact"] = exact_routes(
    "SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey < 10", "SELECT o_orderkey AS workload FROM orders"
)


# telemetry


@query
def telemetry_operations(spark, sf_dir):
    return metrics.operations(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50)


@query
def telemetry_in_flight(spark, sf_dir):
    return metrics.peak_in_flight(metrics.span_changes(table(spark, sf_dir, "events"), "event_type", "ts", "10 MINUTES"))


@query
def telemetry_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "event_type", "value", 10)


@query
def telemetry_spans(spark, sf_dir):
    """From each user's first signup to the first purchase."""
    events = table(spark, sf_dir, "events")
    first = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias("ts"))
    return metrics.spans(first("signup"), first("purchase"), "user_id").select("user_id", "duration_us")


ORACLES["telemetry_spans"] = """
WITH a AS (SELECT user_id, MIN(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY user_id),
b AS (SELECT user_id, MIN(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT a.user_id, epoch_us(b.t) - epoch_us(a.s) AS duration_us FROM a LEFT JOIN b ON a.user_id = b.user_id
"""


@query
def telemetry_attributes(spark, sf_dir):
    """Attributes of customers: nulls go, long binary values are cut."""
    name = F.encode(F.repeat("c_name", 5), "utf-8")
    attrs = attributes.attribute_map(
        attributes.string("segment", F.col("c_mktsegment")),
        attributes.integer("nation", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey"))),
        attributes.boolean("debt", F.col("c_acctbal") < 0),
        attributes.binary("name", name),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", attrs.alias("a"))
    return rows.select("c_custkey", F.explode("a").alias("key", "value"))


ORACLES["telemetry_attributes"] = """
SELECT c_custkey, 'segment' AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL
UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey > 5
UNION ALL SELECT c_custkey, 'debt', CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END FROM customer WHERE c_acctbal IS NOT NULL
UNION ALL SELECT c_custkey, CASE WHEN length(repeat(c_name, 5)) > 64 THEN 'name_truncated' ELSE 'name' END,
lower(hex(substr(repeat(c_name, 5), 1, 64))) FROM customer WHERE c_name IS NOT NULL
"""


@query
def telemetry_attribute_kinds(spark, sf_dir):
    """The other kinds of attributes, on events."""
    micros = F.col("event_id") * 1_500
    attrs = attributes.attribute_map(
        attributes.double("half", F.col("event_id") % 1000 / 2 + 0.25),
        attributes.time("at", F.col("ts")),
        attributes.duration("took", micros),
        attributes.uuid("trace", F.upper(F.md5(F.col("event_id").cast("string")))),
        attributes.type_name("type", F.col("event_id")),
    )
    return table(spark, sf_dir, "events").select("event_id", F.explode(attrs).alias("key", "value"))


ORACLES["telemetry_attribute_kinds"] = """
SELECT event_id, 'half' AS key, CAST(event_id % 1000 / 2 + 0.25 AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'at', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') FROM events
UNION ALL SELECT event_id, 'took', CAST(CAST(event_id * 1500 / 1000000 AS DECIMAL(20, 6)) AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'trace', md5(CAST(event_id AS VARCHAR)) FROM events
UNION ALL SELECT event_id, 'type', 'bigint' FROM events
"""


# signals, topics, states, sets


@query
def signal_event(spark, sf_dir):
    return signals.coalesced_signals(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "view", "click")


@query
def signal_latch(spark, sf_dir):
    return signals.latched_reads(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "signup", "click")


@query
def topic_fanout(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    signups = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("sub_at"), F.max("ts").alias("unsub_at"))
    return signals.fan_out(events.where("event_type = 'purchase'").select("event_id", "ts"), signups)


@query
def fsm_transitions(spark, sf_dir):
    return signals.transitions(views.stream(spark, sf_dir), "stream_id", "event_type", ["stream_offset"])


@query
def ordered_set(spark, sf_dir):
    kept = signals.last_operation_wins(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "signup", "error")
    return signals.ordered_set(kept)


@query
def exchange_responses(spark, sf_dir):
    """Orders as requests, answered by their line count or by an error."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"))
    counts = views.event_counts(spark, sf_dir).select(F.col("command_id").alias("request_id"), F.col("n_events").alias("value"))
    answers = orders.join(counts, "request_id", "left").withColumn("error", F.when(F.col("value").isNull(), "no lines"))
    joined = signals.join_responses(orders, answers, "request_id")
    return joined.select("request_id", "result.value", "result.error")


ORACLES["exchange_responses"] = """
WITH c AS (SELECT l_orderkey, COUNT(*) AS value FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS request_id, value, CASE WHEN value IS NULL THEN 'no lines' END AS error
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
"""


# streaming


@query
def ledger_ingest(spark, sf_dir):
    """All events taken as a stream into a ledger, exactly once, with dense offsets."""
    place = f"{shared_dir(spark)}/stratalog/ledger-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern may match a single file
    rows = source.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("message_id"), "event_type", "ts")
    schema = "stream_id bigint, message_id bigint, event_type string, ts timestamp_ntz"
    ledger = Ledger(spark, f"{place}/data", "stream_id", "message_id", ["ts", "message_id"], schema)
    running = ledger.ingest(rows, f"{place}/checkpoint")
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return ledger.read().select("stream_id", "stream_offset", "message_id")


ORACLES["ledger_ingest"] = _SPECIFIED["stream_offsets"]


# beyond the inventory: state folded from events, and rules from events to commands


@query
def aggregate_state(spark, sf_dir):
    """Each stream's state after its last event: counts by type and the last type."""
    rows = views.stream(spark, sf_dir).groupBy("stream_id")
    return rows.agg(
        F.max_by("event_type", "stream_offset").alias("last_type"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        (F.max("stream_offset") + 1).alias("version"),
    )


ORACLES["aggregate_state"] = """
WITH x AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS rk FROM events)
SELECT user_id AS stream_id, MAX(CASE WHEN rk = 1 THEN event_type END) AS last_type,
CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases, COUNT(*) AS version FROM x GROUP BY user_id
"""


@query
def process_commands(spark, sf_dir):
    """Commands that a process issues: a refund check for each error right after a purchase."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("stream_offset")
    rows = views.stream(spark, sf_dir).withColumn("before", F.lag("event_type").over(w))
    hit = rows.where("event_type = 'error' AND before = 'purchase'")
    return hit.select("stream_id", F.col("message_id").alias("causation_id"), F.lit("check refund").alias("command"))


ORACLES["process_commands"] = """
WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id AS stream_id, event_id AS causation_id, 'check refund' AS command FROM x WHERE event_type = 'error' AND b = 'purchase'
"""
