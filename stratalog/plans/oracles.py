"""The queries in SQL, as DuckDB runs them on the same tables."""

from __future__ import annotations

STREAM = """
e AS (SELECT user_id AS stream_id, event_id AS message_id, event_type, ts, CAST(ts AS DATE) AS d, CAST(row_number()
OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS stream_offset FROM events)"""

RECORDS = f"""
{STREAM}, r AS (SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY d) AS BIGINT) - 1 AS pos,
MIN(stream_offset) AS offset_before, MAX(stream_offset) + 1 AS offset_after, MIN(message_id) AS first_message_id,
COUNT(*) AS n_events FROM e GROUP BY stream_id, d)"""

COMMANDS = """
ev AS (SELECT l_orderkey AS command_id, COUNT(*) AS n_events FROM lineitem GROUP BY l_orderkey),
acc AS (SELECT
o_orderkey AS command_id, o_orderpriority AS handler FROM orders),
han AS (SELECT o.o_orderkey AS command_id,
COALESCE(ev.n_events, 0) AS n_events FROM orders o LEFT JOIN ev ON ev.command_id = o.o_orderkey WHERE o.o_orderstatus
IN ('P','F')),
app AS (SELECT o.o_orderkey AS command_id FROM orders o JOIN ev ON ev.command_id = o.o_orderkey WHERE
o.o_orderstatus = 'F')"""

HEARTBEATS = """
h AS (SELECT user_id % 20 AS node_id, ts, event_id, ts + INTERVAL 6 HOURS AS expires_at FROM events)"""

SCORES = """
nodes AS (SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey < 10),
score AS (SELECT o.o_orderkey AS workload,
n.node_id, md5(CONCAT(CAST(n.node_id AS STRING), ':', CAST(o.o_orderkey AS STRING))) AS s FROM orders o CROSS JOIN
nodes n),
ranked AS (SELECT workload, node_id, CAST(row_number() OVER (PARTITION BY workload ORDER BY s DESC, node_id)
AS BIGINT) AS rk FROM score)"""

ORACLES = {
    "stream_offsets": f"""
WITH {STREAM} SELECT stream_id, stream_offset, message_id FROM e
""",
    "stream_scan_range": f"""
WITH {STREAM} SELECT stream_id, stream_offset, message_id FROM e WHERE stream_offset >= 10 AND stream_offset < 20
""",
    "append_records": f"""
WITH {RECORDS} SELECT * FROM r
""",
    "journal_bounds": f"""
WITH {RECORDS} SELECT stream_id, MIN(pos) AS begin_pos, MAX(pos) + 1 AS end_pos, MAX(offset_after) AS next_offset FROM
r GROUP BY stream_id
""",
    "journal_last_record": f"""
WITH {RECORDS}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY pos DESC) AS BIGINT) AS rk
FROM r) SELECT stream_id, pos, offset_before, offset_after FROM x WHERE rk = 1
""",
    "search_by_offset": f"""
WITH {RECORDS} SELECT stream_id, pos, offset_before, offset_after FROM r WHERE offset_before <= 5 AND offset_after > 5
""",
    "append_contiguity": f"""
WITH {RECORDS}, x AS (SELECT *, lag(offset_after, 1, 0) OVER (PARTITION BY stream_id ORDER BY pos) AS prev FROM r)
SELECT stream_id, COUNT(*) AS n_records, CAST(SUM(CASE WHEN prev = offset_before THEN 0 ELSE 1 END) AS BIGINT) AS gaps
FROM x GROUP BY stream_id
""",
    "append_dedup": f"""
WITH {RECORDS}, tail AS (SELECT stream_id, MAX(offset_after) AS next_offset FROM r GROUP BY stream_id), req AS (SELECT
stream_id, first_message_id, n_events, offset_before AS hint FROM r WHERE pos = 2 UNION ALL SELECT stream_id,
first_message_id + 1000000, n_events, offset_after FROM r WHERE pos = 2) SELECT q.stream_id, q.first_message_id,
COALESCE(p.offset_before, t.next_offset) AS begin_offset, COALESCE(p.offset_after, t.next_offset + q.n_events) AS
end_offset, p.pos IS NOT NULL AS by_prior FROM req q JOIN tail t ON t.stream_id = q.stream_id LEFT JOIN r p ON
p.stream_id = q.stream_id AND p.first_message_id = q.first_message_id AND q.hint < t.next_offset AND p.offset_after >
q.hint
""",
    "recover_unhandled": f"""
WITH {COMMANDS} SELECT command_id, handler FROM acc a WHERE NOT EXISTS (SELECT 1 FROM han h WHERE h.command_id =
a.command_id)
""",
    "recover_unappended": f"""
WITH {COMMANDS} SELECT command_id, n_events FROM han h WHERE NOT EXISTS (SELECT 1 FROM app p WHERE p.command_id =
h.command_id)
""",
    "recover_summary": f"""
WITH {COMMANDS} SELECT a.handler, COUNT(*) AS accepted, CAST(SUM(CASE WHEN h.command_id IS NULL THEN 1 ELSE 0 END) AS
BIGINT) AS unhandled, CAST(SUM(CASE WHEN h.command_id IS NOT NULL AND p.command_id IS NULL THEN 1 ELSE 0 END) AS
BIGINT) AS unappended, CAST(SUM(CASE WHEN h.n_events > 0 AND p.command_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS
to_append FROM acc a LEFT JOIN han h ON h.command_id = a.command_id LEFT JOIN app p ON p.command_id = a.command_id
GROUP BY a.handler
""",
    "accept_idempotent": """
WITH push AS (SELECT o_orderkey AS command_id, 0 AS attempt FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders
WHERE o_orderkey % 7 = 0), x AS (SELECT *, CAST(row_number() OVER (PARTITION BY command_id ORDER BY attempt) AS
BIGINT) AS rk FROM push) SELECT CASE WHEN rk = 1 THEN 'accepted' ELSE 'ignored_duplicate' END AS outcome, COUNT(*) AS
n FROM x GROUP BY 1
""",
    "record_events": """
SELECT l_orderkey AS causation_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) - 1 AS
ordinal, l_partkey, l_suppkey FROM lineitem
""",
    "offset_hints": f"""
WITH {COMMANDS}, x AS (SELECT o.o_custkey AS stream_id, o.o_orderkey AS command_id, o.o_orderdate AS created_at,
h.n_events FROM orders o JOIN han h ON h.command_id = o.o_orderkey WHERE h.n_events > 0) SELECT stream_id, command_id,
COALESCE(CAST(SUM(n_events) OVER (PARTITION BY stream_id ORDER BY created_at, command_id ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS offset_hint, n_events FROM x
""",
    "causation_lineage": """
SELECT o.o_orderkey AS causation_id, o.o_custkey AS correlation_id, l.l_returnflag AS event_type, COUNT(*) AS n FROM
lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3
""",
    "registry_live": f"""
WITH {HEARTBEATS} SELECT node_id, MAX(expires_at) AS expires_at FROM h WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'
GROUP BY node_id HAVING MAX(expires_at) > TIMESTAMP '2024-01-10 00:00:00'
""",
    "registry_leases": f"""
WITH {HEARTBEATS}, g AS (SELECT *, CASE WHEN lag(expires_at) OVER (PARTITION BY node_id ORDER BY ts, event_id) >= ts
THEN 0 ELSE 1 END AS is_new FROM h), s AS (SELECT *, CAST(SUM(is_new) OVER (PARTITION BY node_id ORDER BY ts, event_id
ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lease_no FROM g) SELECT node_id, lease_no, MIN(ts) AS registered_at,
MAX(expires_at) AS expired_at, COUNT(*) AS renewals FROM s GROUP BY node_id, lease_no
""",
    "membership_changed": f"""
WITH {HEARTBEATS}, polls AS (SELECT DISTINCT date_trunc('day', ts) AS t FROM events), live AS (SELECT p.t, h.node_id
FROM polls p JOIN h ON h.ts <= p.t AND h.expires_at > p.t GROUP BY p.t, h.node_id), nxt AS (SELECT t + INTERVAL 1 DAY
AS t, node_id FROM live) SELECT COALESCE(c.t, n.t) AS poll_at, COALESCE(c.node_id, n.node_id) AS node_id, CASE WHEN
n.node_id IS NULL THEN 'registered' ELSE 'deregistered' END AS change FROM live c FULL OUTER JOIN nxt n ON c.t = n.t
AND c.node_id = n.node_id WHERE (c.node_id IS NULL OR n.node_id IS NULL) AND COALESCE(c.t, n.t) <= (SELECT MAX(t) FROM
polls)
""",
    "rendezvous_route": f"""
WITH {SCORES} SELECT workload, node_id FROM ranked WHERE rk = 1
""",
    "rendezvous_balance": f"""
WITH {SCORES} SELECT node_id, COUNT(*) AS n FROM ranked WHERE rk = 1 GROUP BY node_id
""",
    "rendezvous_remove_node": f"""
WITH {SCORES}, aft AS (SELECT workload, node_id, CAST(row_number() OVER (PARTITION BY workload ORDER BY s DESC,
node_id) AS BIGINT) AS rk FROM score WHERE node_id <> 3) SELECT b.node_id AS before_node, a.node_id AS after_node,
COUNT(*) AS n FROM ranked b JOIN aft a ON a.workload = b.workload AND a.rk = 1 WHERE b.rk = 1 GROUP BY 1, 2
""",
    "ordered_set": """
WITH ops AS (SELECT user_id AS member, event_type AS op, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts
DESC, event_id DESC) AS BIGINT) AS rk FROM events WHERE event_type IN ('signup','error')) SELECT member,
CAST(row_number() OVER (ORDER BY member) AS BIGINT) - 1 AS idx FROM ops WHERE rk = 1 AND op = 'signup'
""",
    "telemetry_operations": """
SELECT event_type AS operation, COUNT(*) AS n, CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS errors
FROM events GROUP BY event_type
""",
    "telemetry_in_flight": """
WITH d AS (SELECT event_type AS operation, ts AS change_at, 1 AS delta FROM events UNION ALL SELECT event_type, ts +
INTERVAL 10 MINUTES, -1 FROM events), s AS (SELECT operation, CAST(SUM(delta) OVER (PARTITION BY operation ORDER BY
change_at, delta ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM d) SELECT operation, MAX(in_flight) AS peak
FROM s GROUP BY operation
""",
    "telemetry_histogram": """
SELECT event_type AS operation, CAST(floor(value / 10) AS BIGINT) AS bucket, COUNT(*) AS n FROM events GROUP BY 1, 2
""",
    "signal_event": """
WITH x AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
AS prev FROM events WHERE event_type IN ('view','click')) SELECT user_id, CAST(SUM(CASE WHEN event_type = 'click' AND
prev = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS reads_ok, CAST(SUM(CASE WHEN event_type = 'view' AND prev = 'view' THEN
1 ELSE 0 END) AS BIGINT) AS coalesced FROM x GROUP BY user_id
""",
    "signal_latch": """
WITH l AS (SELECT user_id, MIN(ts) AS latched_at FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT
e.user_id, CAST(SUM(CASE WHEN e.ts >= l.latched_at THEN 1 ELSE 0 END) AS BIGINT) AS reads_after_latch FROM events e
LEFT JOIN l ON l.user_id = e.user_id WHERE e.event_type = 'click' GROUP BY e.user_id
""",
    "topic_fanout": """
WITH sub AS (SELECT user_id, MIN(ts) AS sub_at, MAX(ts) AS unsub_at FROM events WHERE event_type = 'signup' GROUP BY
user_id), pub AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, COUNT(s.user_id)
AS deliveries FROM pub p LEFT JOIN sub s ON p.ts >= s.sub_at AND p.ts < s.unsub_at GROUP BY p.event_id
""",
    "fsm_transitions": f"""
WITH {STREAM}, x AS (SELECT event_type AS s0, lead(event_type) OVER (PARTITION BY stream_id ORDER BY stream_offset) AS
s1 FROM e) SELECT s0, s1, COUNT(*) AS n FROM x WHERE s1 IS NOT NULL GROUP BY s0, s1
""",
}
