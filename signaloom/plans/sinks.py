"""Queries that write through a sink and read back what was written, and JSON key extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import reports as R
from ..operators import sessions as S
from ..session import cut_lineage, fresh_path
from ..sources import messages as SM
from ..sources import sinks as SK
from ..sources.tables import VersionedTable
from .bindings import bound, check, table
from .calls import _SIP
from .registry import register
from .sessions import _OWNED


@register(
    "session_documents",
    check(
        """WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, l_linenumber, l_partkey, l_suppkey, bytes, interface) AS no FROM leg_messages),
        g AS (SELECT session_id, (no - 1) // 2 AS part, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes, min(no) AS first_no FROM n GROUP BY 1, 2)
        SELECT g.*, s.session_type FROM g JOIN call_sessions s USING (session_id)""",
        "leg_messages", "call_sessions",
    ),
)
def _(spark, sf):
    """Documents are written as JSON lines and parsed again."""
    order = ["ts", "l_linenumber", "l_partkey", "l_suppkey", "bytes", "interface"]
    messages = bound(spark, sf, "leg_messages").select("session_id", *order)
    documents = SK.session_documents(
        bound(spark, sf, "call_sessions").select("session_id", "session_type", "start_ts"), messages, "session_id", order,
        ["interface", "bytes"], events_per_document=2,
    )
    path = fresh_path(spark, "documents")
    SK.write_json(documents, path)
    schema = "session_id bigint, part bigint, session_type string, events array<struct<event_no:bigint,interface:string,bytes:bigint>>"
    back = spark.read.schema(schema).json(path)
    return back.select(
        "session_id", "part", "session_type", F.size("events").cast("bigint").alias("events"),
        F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + e["bytes"]).alias("bytes"),
        F.element_at("events", 1)["event_no"].alias("first_no"),
    )


@register(
    "master_documents",
    check(
        _OWNED + """, n AS (SELECT *, row_number() OVER (PARTITION BY imsi, user_id ORDER BY ts, message_id) AS no FROM o WHERE imsi IS NOT NULL),
        p AS (SELECT imsi, user_id, (no - 1) // 3 AS piece, min(ts) AS f, count(*) AS events, CAST(sum(message_id) AS BIGINT) AS ids FROM n GROUP BY 1, 2, 3),
        q AS (SELECT *, (row_number() OVER (PARTITION BY imsi ORDER BY f, user_id, piece) - 1) // 4 AS part FROM p),
        h AS (SELECT imsi, count(*) AS whole FROM o WHERE imsi IS NOT NULL GROUP BY 1)
        SELECT imsi, part, whole, count(*) AS pieces, CAST(sum(events) AS BIGINT) AS events, CAST(sum(ids) AS BIGINT) AS ids, CAST(sum(piece) AS BIGINT) AS continued
        FROM q JOIN h USING (imsi) GROUP BY 1, 2, 3""",
        "messages",
    ),
)
def _(spark, sf):
    """Documents of subscribers with their sessions and events, written as JSON lines and parsed again."""
    order = ["ts", "message_id"]
    owned = cut_lineage(S.subscriber_messages(bound(spark, sf, "messages"), "message_id", order).filter("imsi is not null"), "owned")
    heads = owned.groupBy("imsi").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_update_ts"), F.count(F.lit(1)).alias("whole"))
    documents = SK.master_documents(
        heads, owned, "imsi", "user_id", order, ["message_id", "protocol", "message_type"], events_per_piece=3, pieces_per_document=4
    )
    path = fresh_path(spark, "masters")
    SK.write_json(documents, path)
    schema = "imsi string, part bigint, whole bigint, sessions array<struct<user_id: bigint, piece: bigint, events: array<struct<event_no: bigint, message_id: bigint>>>>"
    back = spark.read.schema(schema).json(path)
    pieces = back.select("imsi", "part", "whole", F.explode("sessions").alias("s"))
    events = F.size("s.events").cast("bigint")
    ids = F.aggregate("s.events", F.lit(0).cast("bigint"), lambda a, e: a + e["message_id"])
    return pieces.groupBy("imsi", "part", "whole").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(events).alias("events"), F.sum(ids).alias("ids"), F.sum("s.piece").alias("continued")
    )


@register(
    "job_result_documents",
    check(
        """WITH r AS (SELECT job_id, line, packets, bytes, row_number() OVER (PARTITION BY job_id ORDER BY line) AS no FROM (
          SELECT job_id, line, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM job_sessions WHERE line < 4 GROUP BY 1, 2)),
        s AS (SELECT job_id, count(*) AS total_sessions, CAST(sum(packets) AS BIGINT) AS total_events FROM r GROUP BY 1),
        p AS (SELECT job_id, (no - 1) // 2 AS part, count(*) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes, min(no) AS first_no FROM r GROUP BY 1, 2)
        SELECT job_id, coalesce(part, 0) AS part, status, coalesce(total_sessions, 0) AS total_sessions, coalesce(total_events, 0) AS total_events,
          coalesce(sessions, 0) AS sessions, coalesce(bytes, 0) AS bytes, first_no FROM jobs LEFT JOIN s USING (job_id) LEFT JOIN p USING (job_id)""",
        "jobs", "job_sessions",
    ),
)
def _(spark, sf):
    """Results of jobs with their sessions and a summary, written as JSON lines and parsed again."""
    sessions = bound(spark, sf, "job_sessions").filter("line < 4").groupBy("job_id", "line").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    jobs = bound(spark, sf, "jobs").select("job_id", "status", "created_ts")
    documents = SK.job_documents(jobs, sessions, "job_id", ["line"], ["line", "packets", "bytes"], "packets", sessions_per_document=2)
    path = fresh_path(spark, "results")
    SK.write_json(documents, path)
    schema = "job_id bigint, part bigint, status string, summary struct<total_sessions: bigint, total_events: bigint>, sessions array<struct<event_no: bigint, bytes: bigint>>"
    return spark.read.schema(schema).json(path).select(
        "job_id", "part", "status", "summary.total_sessions", "summary.total_events", F.size("sessions").cast("bigint").alias("sessions"),
        F.aggregate("sessions", F.lit(0).cast("bigint"), lambda a, e: a + e["bytes"]).alias("bytes"), F.get("sessions", F.lit(0))["event_no"].alias("first_no"),
    )


@register(
    "sip_documents",
    check(
        _SIP + """, e AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY ts, frame_number) AS no, ts // 1000 AS ms,
          CASE WHEN is_request THEN method ELSE status_code || CASE status_code WHEN 100 THEN ' Trying' WHEN 180 THEN ' Ringing' WHEN 183 THEN ' Progress' WHEN 200 THEN ' OK' ELSE '' END END AS name FROM sip),
        p AS (SELECT call_id, (no - 1) // 5 AS part, string_agg(name, ',' ORDER BY no) AS names, CAST(sum(ms) AS BIGINT) AS ms FROM e GROUP BY 1, 2)
        SELECT call_id, part, session_type, caller, callee, start_ts // 1000 AS start_time, end_ts // 1000 AS end_time, messages AS message_count, names, ms FROM p JOIN calls USING (call_id)""",
        "sip",
    ),
)
def _(spark, sf):
    """SIP sessions with their messages, written as JSON lines and parsed again."""
    order = ["ts", "frame_number"]
    sip = bound(spark, sf, "sip")
    calls = C.sip_sessions(sip, "call_id", order).select("call_id", "session_type", "caller", "callee", "caller_ip", "callee_ip", "start_ts", "end_ts", "messages")
    path = fresh_path(spark, "sip-documents")
    SK.write_json(SK.sip_documents(calls, sip, order, ["frame_number"], events_per_document=5), path)
    schema = """call_id string, part bigint, session_type string, caller string, callee string, start_time bigint, end_time bigint, message_count bigint,
        events array<struct<timestamp: bigint, message_type: string>>"""
    return spark.read.schema(schema).json(path).select(
        "call_id", "part", "session_type", "caller", "callee", "start_time", "end_time", "message_count", F.array_join("events.message_type", ",").alias("names"),
        F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + e["timestamp"]).alias("ms"),
    )


@register(
    "session_summaries",
    check("SELECT session_id, session_type, state FROM call_sessions", "call_sessions"),
)
def _(spark, sf):
    path = fresh_path(spark, "summaries")
    SK.write_json(SK.session_summaries(bound(spark, sf, "call_sessions").select("session_id", "session_type", "state")), path)
    return spark.read.schema("session_id bigint, session_type string, state string").json(path)


@register(
    "table_sink",
    check("SELECT state, count(*) AS n, round(sum(volume), 2) AS volume FROM call_sessions GROUP BY 1", "call_sessions"),
)
def _(spark, sf):
    """Three inserts, the later ones with new and with known ids: every session is there once."""
    sessions = bound(spark, sf, "call_sessions")
    path = fresh_path(spark, "sessions")
    part = F.pmod(F.xxhash64("session_id"), F.lit(3))
    SK.write_table(sessions.filter(part == 0).unionByName(sessions.filter(part == 0)), path, "session_id", "state")
    SK.write_table(sessions.filter(part < 2), path, "session_id", "state")
    SK.write_table(sessions, path, "session_id", "state")
    return spark.read.parquet(path).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


@register(
    "expired_jobs_in_storage",
    check(
        """WITH j AS (SELECT * FROM jobs WHERE created_ts >= epoch_us(TIMESTAMP '1997-06-01')),
        s AS (SELECT job_id, line, sum(packets) AS packets FROM job_sessions WHERE job_id IN (SELECT job_id FROM j) GROUP BY 1, 2)
        SELECT 'jobs' AS kept, count(*) AS n, CAST(coalesce(sum(job_id), 0) AS BIGINT) AS ids FROM j UNION ALL SELECT 'sessions', count(*), CAST(coalesce(sum(packets), 0) AS BIGINT) FROM s""",
        "jobs", "job_sessions",
    ),
)
def _(spark, sf):
    """Jobs and their sessions are inserted in two goes, then expired jobs go from the files; what is left is read back."""
    jobs = bound(spark, sf, "jobs").select("job_id", "created_ts", "status")
    sessions = bound(spark, sf, "job_sessions").groupBy("job_id", "line").agg(F.sum("packets").alias("packets"))
    sessions = sessions.select(F.concat_ws("/", "job_id", "line").alias("session_id"), "job_id", "packets")
    kept_jobs = VersionedTable(spark, fresh_path(spark, "jobs"), "job_id bigint, created_ts timestamp, status string", "job_id", slices=16)
    kept_sessions = VersionedTable(spark, fresh_path(spark, "job-sessions"), "session_id string, job_id bigint, packets bigint", "job_id", slices=16)
    for part in (F.col("job_id") % 3 == 0, F.lit(True)):
        kept_jobs.insert(jobs.filter(part), "job_id")
        kept_sessions.insert(sessions.filter(part), "session_id")
    expired = kept_jobs.read().filter("created_ts < TIMESTAMP '1997-06-01'").select("job_id")
    expired = cut_lineage(expired, "expired")
    kept_sessions.remove(expired)
    kept_jobs.remove(expired)
    counted = [
        kept_jobs.read().agg(F.lit("jobs").alias("kept"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("job_id"), F.lit(0)).alias("ids")),
        kept_sessions.read().agg(F.lit("sessions").alias("kept"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("packets"), F.lit(0)).alias("ids")),
    ]
    return counted[0].unionByName(counted[1])


@register(
    "metrics_file",
    """SELECT '# TYPE signaloom_events counter' AS line UNION ALL
    SELECT 'signaloom_events{event_type="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type""",
)
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    path = fresh_path(spark, "metrics")
    SK.write_metrics(R.metric_lines(counts, "signaloom", {"events": "counter"}, ["event_type"]), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@register(
    "declared_schema_scan",
    "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(spark, sf):
    rows = SM.read_messages(spark, f"{sf}/events.parquet", "event_id bigint, event_type string, props string")
    body = F.from_json("props", "k bigint")
    return rows.select("event_id", "event_type", body["k"].alias("k"))


@register(
    "capture_union",
    """SELECT 'orders' AS interface_id, count(*) AS n, count(price) AS priced FROM (SELECT o_totalprice AS price FROM orders)
    UNION ALL SELECT 'lineitem', count(*), 0 FROM lineitem""",
)
def _(spark, sf):
    captures = {
        "orders": table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS price"),
        "lineitem": table(spark, sf, "lineitem").selectExpr("l_orderkey AS id"),
    }
    return SM.union_captures(captures).groupBy("interface_id").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"))


_BODY = """CASE protocol
  WHEN 'GTP_C' THEN '{"header":{"teid":' || teid || '},"imsi":"' || coalesce(imsi, '') || '","ue_ipv4":"' || src_ip || '"}'
  WHEN 'SIP' THEN '{"call_id":"' || icid || '","p_charging_vector":{"icid_value":"' || icid || '"},"p_asserted_identity":[{"username":"'
    || CASE k % 3 WHEN 0 THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') WHEN 1 THEN '+1415' || lpad(CAST(user_id AS STRING), 7, '0') ELSE 'alice' END
    || '"}],"sdp":{"connection_address":"' || CASE WHEN k % 2 = 0 THEN src_ip ELSE '2001:db8::1' END || '"}}'
  WHEN 'DIAMETER' THEN '{"user_name":"310260' || lpad(CAST(user_id AS STRING), 9, '0') || '","subscription_ids":[{"type":0,"data":"1415' || k || '"}]}'
  ELSE '{}' END"""


@register(
    "extracted_keys",
    check(
        """SELECT message_id, CASE WHEN protocol = 'GTP_C' THEN coalesce(imsi, '') WHEN protocol = 'DIAMETER' OR (protocol = 'SIP' AND k % 3 = 0)
            THEN '310260' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS imsi,
          CASE WHEN protocol = 'DIAMETER' THEN '1415' || k WHEN protocol = 'SIP' AND k % 3 = 1 THEN '1415' || lpad(CAST(user_id AS VARCHAR), 7, '0') END AS msisdn,
          CASE WHEN protocol = 'SIP' THEN icid END AS icid, CASE WHEN protocol = 'GTP_C' OR (protocol = 'SIP' AND k % 2 = 0) THEN src_ip END AS ue_ipv4,
          CASE WHEN protocol = 'SIP' AND k % 2 = 1 THEN '2001:db8::1' END AS ue_ipv6, teid AS teid_s1u FROM messages""",
        "messages",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "messages").select("message_id", "protocol", F.expr(_BODY).alias("parsed_data"))
    keyed = SM.with_correlation_keys(rows)
    return keyed.select("message_id", "imsi", "msisdn", "icid", "ue_ipv4", "ue_ipv6", "teid_s1u")


_USER_PLANE = """CASE event_type
  WHEN 'purchase' THEN '{"header":{"seid":' || (user_id * 1000003) || '},"ue_ip_address":"' || src_ip || '","imsi":"310260' || lpad(CAST(user_id AS STRING), 9, '0') || '"}'
  WHEN 'error' THEN '{"ran_ue_ngap_id":' || k || ',"amf_ue_ngap_id":' || user_id || '}'
  ELSE '{"p_associated_uri":["tel:+1","sip:310260' || lpad(CAST(user_id AS STRING), 9, '0') || '@ims.example.com"]}' END"""


@register(
    "extracted_user_plane_keys",
    check(
        """SELECT message_id, CASE WHEN event_type <> 'error' THEN '310260' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS imsi,
          CASE WHEN event_type = 'purchase' THEN src_ip END AS ue_ipv4, CASE WHEN event_type = 'purchase' THEN CAST(user_id * 1000003 AS DECIMAL(20, 0)) END AS seid_n4,
          CASE WHEN event_type = 'error' THEN CAST(k AS DECIMAL(20, 0)) END AS ran_ue_ngap_id,
          CASE WHEN event_type = 'error' THEN CAST(user_id AS DECIMAL(20, 0)) END AS amf_ue_ngap_id FROM messages""",
        "messages",
    ),
)
def _(spark, sf):
    """Keys out of PFCP and NGAP bodies, and an IMSI out of a SIP message's associated URIs."""
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'PFCP' WHEN 'error' THEN 'SCTP' ELSE 'SIP' END")
    rows = bound(spark, sf, "messages").select("message_id", kind.alias("protocol"), F.expr(_USER_PLANE).alias("parsed_data"))
    keyed = SM.with_correlation_keys(rows)
    return keyed.select("message_id", "imsi", "ue_ipv4", "seid_n4", "ran_ue_ngap_id", "amf_ue_ngap_id")
