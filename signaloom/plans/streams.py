"""Streaming queries: the events table read as a stream, compared with what a batch gives for closed time."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path, use_utc
from ..sources.messages import stream_messages
from ..streaming import ordered as O
from ..streaming import windows as W
from ..streaming.merging import OnlineMerge
from ..streaming.running import run_batches, run_counting_late, run_to_table
from ..streaming.totals import SignedTotals
from .bindings import BINDINGS, bound, check, table
from .registry import register


def _stream(spark, sf, name):
    """A binding over the events table as a stream."""
    use_utc(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = stream_messages(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(re.sub(r"\bTS\((\w+)\)", r"\1", BINDINGS[name]), events=events)


def _in_parts(spark, rows, order, feed, parts=3):
    """Hand ``rows`` to ``feed(stream)`` in parts that arrive one after the other in the order of time; the last result.

    Each part is a run of its own that goes on from where the one before stopped, so this is a restart each time.
    """
    rows = cut_lineage(rows, "events")
    at = F.unix_micros(order)
    low, high = rows.agg(F.min(at), F.max(at)).first()
    path, found = fresh_path(spark, "arrivals"), None
    for part in range(parts):
        slot = F.least(F.floor((at - low) * parts / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(parts - 1))
        arrived = rows.filter(F.coalesce(slot, F.lit(0)) == part)
        arrived.write.mode("append").parquet(path)
        found = feed(spark.readStream.schema(rows.schema).parquet(path))
    return found


# What the watermark has passed when everything available was read: latest time less the delay, in milliseconds.
_CLOSED = "wm AS (SELECT max(ts) // 1000 - 600000 AS ms FROM messages)"


def _closed(rows: str) -> str:
    """The same when only some rows are read by the stream."""
    return _CLOSED[:-1] + f" WHERE {rows})"


@register(
    "stream_expired_flows",
    check(
        f"""WITH {_CLOSED}, g AS (SELECT user_id, ts, payload_length, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, message_id) < 7200000000 THEN 0 ELSE 1 END AS b, message_id FROM messages),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS f FROM g)
        SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS packets, CAST(sum(payload_length) AS BIGINT) AS bytes FROM s GROUP BY user_id, f
        HAVING (max(ts) + 7200000000) // 1000 <= (SELECT ms FROM wm)""",
        "messages",
    ),
)
def _(spark, sf):
    flows = W.expired_flows(_stream(spark, sf, "messages"), "ts", ["user_id"], "payload_length", idle_seconds=7200)
    return run_to_table(flows, "flows")[0]


@register(
    "stream_tumbling_counts",
    check(
        f"""WITH {_CLOSED} SELECT ts // 3600000000 * 3600000000 AS bucket, protocol, count(*) AS n, CAST(sum(payload_length) AS BIGINT) AS bytes FROM messages
        WHERE (ts // 3600000000 + 1) * 3600000 <= (SELECT ms FROM wm) GROUP BY 1, 2""",
        "messages",
    ),
)
def _(spark, sf):
    counts = W.tumbling_counts(_stream(spark, sf, "messages"), "ts", "1 hour", ["protocol"], bytes=F.sum("payload_length"))
    return run_to_table(counts, "counts")[0]


@register("stream_first_of_signature", check("SELECT DISTINCT user_id, k FROM messages", "messages"))
def _(spark, sf):
    """A delay longer than the data keeps exactly one row per signature."""
    rows = _stream(spark, sf, "messages").select("ts", "user_id", "k")
    return run_to_table(W.without_repeats(rows, "ts", ["user_id", "k"], "60 days"), "first")[0].select("user_id", "k")


@register(
    "stream_near_repeats_removed",
    check(
        f"""WITH {_CLOSED}, w AS (SELECT user_id || '/' || event_type AS key, message_id AS row_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, message_id) AS p FROM messages)
        SELECT key, row_id FROM w WHERE (p IS NULL OR ts - p > 3600000000) AND ts // 1000 + 1 <= (SELECT ms FROM wm)""",
        "messages",
    ),
)
def _(spark, sf):
    signature = F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("signature")
    rows, repeats = bound(spark, sf, "messages").select("ts", "message_id", signature), O.NearRepeat(spark, 3_600_000_000)
    return _in_parts(spark, rows, "ts", lambda s: repeats.run(O.keyed_rows(s, "signature", "ts", "message_id", F.lit("ROW"))))


@register(
    "stream_request_pairs",
    check(
        """WITH r AS (SELECT session_id, hop_by_hop_id, frame_number AS request_id, ts AS requested FROM diameter WHERE is_request AND session_id <> ''),
        a AS (SELECT session_id, hop_by_hop_id, ts FROM diameter WHERE NOT is_request AND session_id <> '')
        SELECT session_id, hop_by_hop_id, request_id, requested, (SELECT min(a.ts) FROM a WHERE a.session_id = r.session_id AND a.hop_by_hop_id = r.hop_by_hop_id
          AND a.ts BETWEEN requested AND requested + 21600000000) AS answered FROM r""",
        "diameter",
    ),
)
def _(spark, sf):
    """In parts, then a row of each kind from long after, so that every request comes out."""
    rows = bound(spark, sf, "diameter").filter("session_id <> ''").select("session_id", "hop_by_hop_id", "frame_number", "ts", "is_request")
    path, state = fresh_path(spark, "pairs"), fresh_path(spark, "pairs-state")

    def pair(stream):
        requests = stream.filter("is_request").select("session_id", "hop_by_hop_id", F.col("frame_number").alias("request_id"), F.col("ts").alias("requested"))
        answers = stream.filter("not is_request").select("session_id", "hop_by_hop_id", F.col("ts").alias("answered"))
        pairs = W.request_pairs(requests, answers, ["session_id", "hop_by_hop_id"], "request_id", "requested", "answered", "6 hours")
        return run_to_table(pairs, "pairs", path=path, state_path=state)[0]

    late = "(SELECT max(ts) + interval 60 days FROM {rows})"
    after = spark.sql(f"SELECT '' AS session_id, 0L AS hop_by_hop_id, 0L AS frame_number, {late} AS ts, k AS is_request FROM VALUES (true), (false) AS t(k)", rows=rows)
    _in_parts(spark, rows, "ts", pair)
    return _in_parts(spark, after, "ts", pair, parts=1).filter("session_id <> ''")


@register(
    "stream_address_owner",
    check(
        f"""WITH {_closed("protocol IN ('GTP_C', 'SIP')")}, c AS (SELECT ts, message_id, imsi, src_ip FROM messages WHERE protocol = 'GTP_C'),
        p AS (SELECT ts, message_id, src_ip FROM messages WHERE protocol = 'SIP' AND ts // 1000 + 1 <= (SELECT ms FROM wm)),
        h AS (SELECT p.src_ip AS key, p.message_id AS probe_id, p.ts, (SELECT max_by((c.ts, c.imsi), (c.ts, c.message_id)) FROM c WHERE c.src_ip = p.src_ip AND c.ts <= p.ts) AS r FROM p)
        SELECT key, probe_id, CASE WHEN ts - r[1] <= 432000000000 THEN r[2] END AS value FROM h""",
        "messages",
    ),
)
def _(spark, sf):
    kind = F.expr("CASE protocol WHEN 'GTP_C' THEN 'CLAIM' WHEN 'SIP' THEN 'PROBE' END")
    rows, owners = bound(spark, sf, "messages").select("ts", "message_id", "src_ip", "protocol", "imsi"), O.LastClaim(spark, 432_000_000_000)
    return _in_parts(spark, rows, "ts", lambda s: owners.run(O.keyed_rows(s, "src_ip", "ts", "message_id", kind, F.col("imsi"))))


@register(
    "stream_port_claims",
    check(
        f"""WITH {_closed("protocol IN ('SIP', 'RTP')")}, c AS (SELECT ts, message_id, icid, k AS port FROM messages WHERE protocol = 'SIP'),
        p AS (SELECT ts, message_id, k AS port FROM messages WHERE protocol = 'RTP' AND ts // 1000 + 1 <= (SELECT ms FROM wm)),
        h AS (SELECT CAST(p.port AS VARCHAR) AS key, p.message_id AS probe_id, p.ts, (SELECT max_by((c.ts, c.icid), (c.ts, c.message_id)) FROM c WHERE c.port = p.port AND c.ts <= p.ts) AS r FROM p)
        SELECT key, probe_id, CASE WHEN ts - r[1] <= 43200000000 THEN r[2] END AS value FROM h""",
        "messages",
    ),
)
def _(spark, sf):
    kind = F.expr("CASE protocol WHEN 'SIP' THEN 'CLAIM' WHEN 'RTP' THEN 'PROBE' END")
    rows, ports = bound(spark, sf, "messages").select("ts", "message_id", "k", "protocol", "icid"), O.LastClaim(spark, 43_200_000_000)
    return _in_parts(spark, rows, "ts", lambda s: ports.run(O.keyed_rows(s, "k", "ts", "message_id", kind, F.col("icid"))))


@register(
    "stream_lifecycles",
    check(
        f"""WITH {_CLOSED}, r AS (SELECT user_id, ts, message_id, event_type = 'error' AS is_end, lag(ts) OVER o AS p, lag(event_type) OVER o AS pe FROM messages
          WHERE ts // 1000 + 1 <= (SELECT ms FROM wm) WINDOW o AS (PARTITION BY user_id ORDER BY ts, message_id)),
        s AS (SELECT *, sum(CASE WHEN p IS NULL OR pe = 'error' OR ts - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS life FROM r),
        g AS (SELECT CAST(user_id AS VARCHAR) AS key, min(ts) AS opened_at, max(ts) AS last_at, count(*) AS "rows", bool_or(is_end) AS e, life,
          max(life) OVER (PARTITION BY user_id) = life AS newest FROM s GROUP BY user_id, life)
        SELECT key, opened_at, last_at, "rows", CASE WHEN e THEN 'END' ELSE 'IDLE' END AS ended_by FROM g
        WHERE e OR NOT newest OR (last_at + 21600000000) // 1000 + 1 <= (SELECT ms FROM wm)""",
        "messages",
    ),
)
def _(spark, sf):
    kind = F.expr("CASE event_type WHEN 'error' THEN 'END' ELSE 'ROW' END")
    rows, lives = bound(spark, sf, "messages").select("ts", "message_id", "user_id", "event_type"), O.Lifecycle(spark, 21_600_000_000)
    return _in_parts(spark, rows, "ts", lambda s: lives.run(O.keyed_rows(s, "user_id", "ts", "message_id", kind)))


@register(
    "stream_running_totals",
    check("SELECT interface, count(*) AS n, CAST(sum(payload_length) AS BIGINT) AS bytes FROM messages GROUP BY 1", "messages"),
)
def _(spark, sf):
    totals = W.running_totals(_stream(spark, sf, "messages"), ["interface"], bytes=F.sum("payload_length"))
    path = fresh_path(spark, "totals")
    run_batches(totals, "totals", lambda batch, epoch: batch.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path)


@register(
    "stream_totals_with_deletes",
    check(
        """SELECT interface, count(*) AS n, CAST(sum(payload_length) AS BIGINT) AS total, min(payload_length) AS least, max(payload_length) AS greatest
        FROM messages WHERE NOT (k % 5 = 0 OR payload_length > 200) GROUP BY 1""",
        "messages",
    ),
)
def _(spark, sf):
    """Every message is inserted; some, the longest among them, are deleted two hours later."""
    rows = bound(spark, sf, "messages").select("ts", "interface", "payload_length", "k")
    gone = rows.filter("k % 5 = 0 OR payload_length > 200").withColumn("ts", F.expr("ts + interval 2 hours"))
    signed = rows.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1))).drop("k")
    totals = SignedTotals(spark, ["interface"], "payload_length", compact_every=2)
    return _in_parts(spark, signed, "ts", totals.run)


_LATE_AFTER_MS = 24 * 3600 * 1000
_WATERMARK = f"(SELECT (max(ts) // 1000 - {_LATE_AFTER_MS}) * 1000 AS wm FROM messages)"


@register(
    "stream_late_rows",
    check(
        f"""SELECT (SELECT count(*) FROM messages, {_WATERMARK} WHERE ts <= wm) AS late,
          (SELECT count(*) FROM messages, {_WATERMARK} WHERE ts > wm) AS n""",
        "messages",
    ),
)
def _(spark, sf):
    """The newest events come first, the rest of their day second; everything older is then behind the watermark."""
    rows = bound(spark, sf, "messages").select("message_id", "ts")
    newest = rows.agg(F.max("ts")).scalar()
    passed = (F.floor(F.unix_micros(newest) / 1000) - _LATE_AFTER_MS) * 1000
    fresh, path = F.unix_micros("ts") > passed, fresh_path(spark, "arrivals")
    for part in (F.col("ts") == newest, fresh & (F.col("ts") < newest), ~fresh):
        rows.filter(part).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found, late = run_counting_late(W.without_repeats(arriving, "ts", ["message_id"], f"{_LATE_AFTER_MS} milliseconds"), "late")
    return found.agg(F.lit(late).cast("bigint").alias("late"), F.count(F.lit(1)).alias("n"))


@register(
    "stream_key_merge",
    check(
        """WITH kv AS (SELECT message_id, unnest(['imsi:' || imsi, 'msisdn:' || msisdn]) AS node FROM messages), kn AS (SELECT * FROM kv WHERE node IS NOT NULL),
        anchor AS (SELECT message_id, min(node) AS a FROM kn GROUP BY 1), e1 AS (SELECT DISTINCT a.a, k.node AS b FROM anchor a JOIN kn k USING (message_id) WHERE a.a <> k.node),
        e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1), walk(node, seen) AS (SELECT DISTINCT node, node FROM kn UNION SELECT w.node, e.b FROM walk w JOIN e ON w.seen = e.a),
        root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1), ids AS (SELECT root, min(message_id) AS session_id FROM kn JOIN root USING (node) GROUP BY 1)
        SELECT node, session_id FROM root JOIN ids USING (root)""",
        "messages", recursive=True,
    ),
)
def _(spark, sf):
    keys = {"imsi": F.col("imsi"), "msisdn": F.col("msisdn")}
    merge = OnlineMerge(spark, "message_id", keys, compact_every=3)
    rows = bound(spark, sf, "messages").select("ts", "message_id", "imsi", "msisdn")
    return _in_parts(spark, rows, "ts", merge.run, parts=4)
