"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import sessions as S
from .bindings import bound, check, table
from .registry import register

_DAY_1997 = "TIMESTAMP '1997-01-01 00:00:00'"


@register(
    "protocol_statistics",
    check(
        """SELECT protocol, count(*) AS sessions, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
        count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM job_sessions GROUP BY protocol""",
        "job_sessions",
    ),
)
def _(spark, sf):
    return R.protocol_statistics(bound(spark, sf, "job_sessions"), "protocol", "packets", "bytes")


@register(
    "event_type_share",
    "SELECT event_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM events GROUP BY event_type",
)
def _(spark, sf):
    return R.share_of_total(table(spark, sf, "events"), "event_type")


@register(
    "summary_kpis",
    check(
        f"""WITH j AS (SELECT * FROM jobs WHERE created_ts >= epoch_us({_DAY_1997})),
        s AS (SELECT * FROM job_sessions WHERE job_id IN (SELECT job_id FROM j))
        SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs,
          count(*) FILTER (status = 'failed') AS failed_jobs, count(*) FILTER (status IN ('queued', 'running')) AS active_jobs,
          (SELECT count(*) FROM s) AS total_sessions, (SELECT CAST(sum(packets) AS BIGINT) FROM s) AS total_packets,
          (SELECT CAST(sum(bytes) AS BIGINT) FROM s) AS total_bytes, (SELECT round(avg(duration_ms), 6) FROM s) AS avg_duration_ms,
          (SELECT round(sum(packets) / count(*), 6) FROM s) AS packets_per_session FROM j""",
        "jobs", "job_sessions",
    ),
)
def _(spark, sf):
    kpis = R.summary_kpis(
        bound(spark, sf, "jobs"), bound(spark, sf, "job_sessions"), "status", "created_ts", "packets", "bytes",
        "duration_ms", start=F.expr(_DAY_1997),
    )
    rounded = {c: F.round(c, 6) for c in ("avg_duration_ms", "packets_per_session")}
    return kpis.withColumns(rounded)


@register(
    "message_protocol_share",
    check(
        """SELECT protocol, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM messages GROUP BY protocol""",
        "messages",
    ),
)
def _(spark, sf):
    return R.share_of_total(bound(spark, sf, "messages"), "protocol")


@register(
    "hourly_buckets",
    check(
        """SELECT ts // 3600000000 * 3600 AS bucket, count(*) AS n, CAST(sum(payload_length) AS BIGINT) AS bytes
        FROM messages GROUP BY 1""",
        "messages",
    ),
)
def _(spark, sf):
    return R.time_buckets(bound(spark, sf, "messages"), "ts", "1h", bytes=F.sum("payload_length"))


@register(
    "call_trend",
    check(
        """WITH u AS (SELECT epoch_us(TIMESTAMP '2024-01-20 00:00:00') AS t)
        SELECT ts // 21600000000 * 21600 AS bucket, count(*) AS n, round(avg(payload_length), 6) AS mean_length
        FROM messages, u WHERE ts > t - 604800000000 AND ts <= t GROUP BY 1""",
        "messages",
    ),
)
def _(spark, sf):
    until = F.expr("TIMESTAMP '2024-01-20 00:00:00'")
    return R.trend(bound(spark, sf, "messages"), "ts", until, "7d", mean_length=F.round(F.avg("payload_length"), 6))


@register(
    "period_change",
    check(
        """WITH a AS (SELECT epoch_us(TIMESTAMP '2024-01-20 00:00:00') - ts AS age FROM messages),
        c AS (SELECT count(*) FILTER (age >= 0 AND age < 604800000000) AS "current",
          count(*) FILTER (age >= 604800000000 AND age < 1209600000000) AS previous FROM a)
        SELECT "current", previous, CASE WHEN previous > 0 THEN ("current" - previous) * 100.0 / previous
          WHEN "current" > 0 THEN 100.0 ELSE 0.0 END AS change_percent FROM c""",
        "messages",
    ),
)
def _(spark, sf):
    return R.period_change(bound(spark, sf, "messages"), "ts", F.expr("TIMESTAMP '2024-01-20 00:00:00'"), "1w")


@register(
    "job_performance",
    check(
        """SELECT round(avg(CASE WHEN status = 'completed' THEN size_bytes * 8.0 / 1000000.0 / nullif((done - created_ts) / 1000000.0, 0) END), 9)
          AS avg_throughput_mbps,
          round(avg(CASE WHEN status = 'completed' THEN (done - created_ts) / 1000000.0 END), 6) AS avg_completion_sec,
          count(*) FILTER (status = 'running') AS running_jobs, count(*) FILTER (status = 'queued') AS queued_jobs
        FROM (SELECT *, created_ts + (job_id % 3600) * 1000000 AS done FROM jobs)""",
        "jobs",
    ),
)
def _(spark, sf):
    jobs = bound(spark, sf, "jobs").withColumn("done_ts", F.expr("timestamp_micros(unix_micros(created_ts) + (job_id % 3600) * 1000000)"))
    found = R.job_performance(jobs, "status", "created_ts", "done_ts", "size_bytes")
    return found.withColumns(
        {"avg_throughput_mbps": F.round("avg_throughput_mbps", 9), "avg_completion_sec": F.round("avg_completion_sec", 6)}
    )


@register("type_counts", check("SELECT session_type, count(*) AS n FROM call_sessions GROUP BY session_type", "call_sessions"))
def _(spark, sf):
    return R.type_counts(bound(spark, sf, "call_sessions"), "session_type")


_TALKERS = """SELECT endpoint, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT session_id) AS sessions
  FROM (SELECT src_ip AS endpoint, session_id, bytes, protocol FROM packets UNION ALL
        SELECT dst_ip, session_id, bytes, protocol FROM packets) {where} GROUP BY endpoint"""


@register(
    "top_talkers",
    check(_TALKERS.format(where="") + " ORDER BY packets DESC, endpoint LIMIT 10", "packets"),
)
def _(spark, sf):
    return R.top_talkers(bound(spark, sf, "packets"), ["src_ip", "dst_ip"], "session_id", "bytes")


@register(
    "top_talkers_by_bytes",
    check(_TALKERS.format(where="WHERE protocol = 'SIP'") + " ORDER BY bytes DESC, endpoint LIMIT 10", "packets"),
)
def _(spark, sf):
    packets = bound(spark, sf, "packets")
    return R.top_talkers(packets, ["src_ip", "dst_ip"], "session_id", "bytes", by="bytes", within=F.col("protocol") == "SIP")


@register("endpoint_union", check(_TALKERS.format(where=""), "packets"))
def _(spark, sf):
    return R.talkers(bound(spark, sf, "packets"), ["src_ip", "dst_ip"], "session_id", "bytes")


@register(
    "database_totals",
    """SELECT 'jobs' AS "table", count(*) AS "rows" FROM orders UNION ALL SELECT 'sessions', count(*) FROM lineitem
    UNION ALL SELECT 'events', count(*) FROM events""",
)
def _(spark, sf):
    return R.totals(
        jobs=table(spark, sf, "orders"), sessions=table(spark, sf, "lineitem"), events=table(spark, sf, "events")
    )


@register(
    "metric_lines",
    check(
        """WITH k AS (SELECT status, count(*) AS jobs, CAST(floor(sum(size_bytes)) AS BIGINT) AS bytes FROM jobs GROUP BY status)
        SELECT 'media_jobs' AS metric, 1 AS part, 'media_jobs{status="' || status || '"} ' || jobs AS line FROM k
        UNION ALL SELECT 'media_bytes', 1, 'media_bytes{status="' || status || '"} ' || bytes FROM k
        UNION ALL SELECT 'media_jobs', 0, '# TYPE media_jobs counter' UNION ALL SELECT 'media_bytes', 0, '# TYPE media_bytes gauge'""",
        "jobs",
    ),
)
def _(spark, sf):
    kpis = bound(spark, sf, "jobs").groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.floor(F.sum("size_bytes")).cast("bigint").alias("bytes")
    )
    return R.metric_lines(kpis, "media", {"jobs": "counter", "bytes": "gauge"}, ["status"])


@register(
    "interface_counters",
    check(
        """WITH v AS (SELECT interface_id, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT protocol) AS protocols,
          CAST(sum(l_partkey % 3) AS BIGINT) AS drops FROM packets GROUP BY 1),
        p AS (SELECT interface_id, count(DISTINCT port) AS ports FROM (SELECT interface_id, src_port AS port FROM packets
          UNION ALL SELECT interface_id, dst_port FROM packets) GROUP BY 1)
        SELECT * FROM v JOIN p USING (interface_id)""",
        "packets",
    ),
)
def _(spark, sf):
    packets = bound(spark, sf, "packets").withColumn("lost", F.expr("CAST(l_partkey % 3 AS BIGINT)"))
    return R.interface_counters(packets, "interface_id", "bytes", "protocol", ["src_port", "dst_port"], "lost")


@register(
    "interface_protocols",
    check(
        """SELECT interface_id, protocol, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM packets
        WHERE protocol <> 'UNKNOWN' GROUP BY 1, 2""",
        "packets",
    ),
)
def _(spark, sf):
    return R.interface_protocols(bound(spark, sf, "packets"), "interface_id", "bytes", "protocol")


@register(
    "interface_ports",
    check("SELECT interface_id, src_port AS port FROM packets UNION SELECT interface_id, dst_port FROM packets", "packets"),
)
def _(spark, sf):
    return R.interface_ports(bound(spark, sf, "packets"), "interface_id", ["src_port", "dst_port"])


@register(
    "flow_table",
    check(
        """SELECT src_ip, dst_ip, src_port, dst_port, transport, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS packets,
          CAST(sum(bytes) AS BIGINT) AS bytes,
          min_by(protocol, (ts, packet_id)) FILTER (protocol <> 'UNKNOWN') AS protocol FROM packets GROUP BY ALL""",
        "packets",
    ),
)
def _(spark, sf):
    return S.flow_table(bound(spark, sf, "packets"), ["ts", "packet_id"], "bytes", "protocol")


_FLOW = "src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port"


@register(
    "protocol_session_keys",
    check(
        f"""WITH k AS (SELECT *, CASE WHEN protocol = 'SIP' THEN 'call-' || session_id WHEN protocol = 'DIAMETER' THEN 's-' || l_partkey
          ELSE 'FLOW-' || {_FLOW} END AS session_key FROM packets)
        SELECT session_key, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
          (max(ts) - min(ts)) // 1000 AS duration_ms FROM k GROUP BY session_key""",
        "packets",
    ),
)
def _(spark, sf):
    packets = bound(spark, sf, "packets").selectExpr(
        "*", "'call-' || session_id AS call_id", "'s-' || l_partkey AS diameter_session", "CAST(NULL AS BIGINT) AS teid",
        "CAST(NULL AS BIGINT) AS seid", "CAST(NULL AS BIGINT) AS stream_id",
    )
    key = S.protocol_session_key("protocol", "call_id", "diameter_session", "teid", "seid", "stream_id", F.expr(_FLOW))
    return S.keyed_flow_rollup(packets.withColumn("session_key", key), "session_key", "ts", "bytes")


#: Written in the SQL that both engines share.
_TUNNEL_KEYS = (
    "*", "CASE l_linenumber WHEN 1 THEN 'GTP_C' WHEN 5 THEN 'PFCP' WHEN 6 THEN 'HTTP2' ELSE 'UNKNOWN' END AS kind",
    "l_partkey % 1000 AS teid", "CASE WHEN l_partkey % 3 = 0 THEN l_suppkey * 7 END AS f_seid",
    "CASE WHEN l_partkey % 3 = 1 THEN l_suppkey END AS seid", "l_partkey % 9 AS stream_id",
)


@register(
    "tunnel_session_keys",
    check(
        f"""WITH t AS (SELECT {', '.join(_TUNNEL_KEYS)} FROM packets),
        s AS (SELECT *, CASE kind WHEN 'GTP_C' THEN 'GTP-' || teid WHEN 'PFCP' THEN 'PFCP-' || coalesce(CAST(f_seid AS VARCHAR), CAST(seid AS VARCHAR), {_FLOW})
          WHEN 'HTTP2' THEN 'HTTP2-' || {_FLOW} || '-' || stream_id ELSE 'FLOW-' || {_FLOW} END AS session_key FROM t)
        SELECT session_key, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
          (max(ts) - min(ts)) // 1000 AS duration_ms FROM s GROUP BY session_key""",
        "packets",
    ),
)
def _(spark, sf):
    """Keys of tunnels, PFCP endpoints and HTTP/2 streams."""
    packets = bound(spark, sf, "packets").selectExpr(*_TUNNEL_KEYS, "CAST(NULL AS STRING) AS call_id", "CAST(NULL AS STRING) AS diameter_session")
    key = S.protocol_session_key("kind", "call_id", "diameter_session", "teid", "seid", "stream_id", F.expr(_FLOW), "f_seid")
    return S.keyed_flow_rollup(packets.withColumn("session_key", key), "session_key", "ts", "bytes")
