"""SIP, call flow, participant and diagram queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import diagram as D
from ..operators import filters as FI
from .bindings import bound, check, table
from .registry import register

ORDER = ["ts", "frame_number"]

_SIP = """WITH q AS (SELECT *, is_request AND method = 'INVITE' AS inv, NOT is_request AND status_code BETWEEN 200 AND 299 AND cseq_method = 'INVITE' AS ans FROM sip),
  g AS (SELECT call_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, min_by(method, (ts, frame_number)) FILTER (is_request) AS first_method,
    min_by(expires, (ts, frame_number)) FILTER (is_request) AS ex,
    coalesce(bool_or(inv AND (request_uri LIKE '%urn:service:sos%' OR to_uri LIKE '%urn:service:sos%')), false) AS urgent,
    coalesce(bool_or((inv OR ans) AND has_audio), false) AS audio, coalesce(bool_or((inv OR ans) AND has_video), false) AS video,
    min_by(regexp_extract(from_uri, 'sip:([^@]+)@', 1), (ts, frame_number)) FILTER (is_request) AS caller,
    min_by(regexp_extract(to_uri, 'sip:([^@]+)@', 1), (ts, frame_number)) FILTER (is_request) AS callee,
    min_by(contact_ip, (ts, frame_number)) FILTER (inv AND contact_ip IS NOT NULL) AS caller_ip,
    min_by(contact_ip, (ts, frame_number)) FILTER (ans AND contact_ip IS NOT NULL) AS callee_ip,
    min_by(via_count, (ts, frame_number)) FILTER (inv) AS via, coalesce(bool_or(is_request AND method = 'BYE'), false) AS completed FROM q GROUP BY call_id),
  calls AS (SELECT * EXCLUDE (ex, urgent, audio, video, via), CASE WHEN first_method = 'REGISTER' AND ex = 0 THEN 'DEREGISTRATION' WHEN first_method = 'REGISTER' THEN 'REGISTRATION'
    WHEN first_method = 'INVITE' AND urgent THEN 'EMERGENCY_CALL' WHEN first_method = 'INVITE' AND audio AND video THEN 'VIDEO_CALL'
    WHEN first_method = 'INVITE' THEN 'VOICE_CALL' WHEN first_method = 'MESSAGE' THEN 'SMS_MESSAGE' ELSE 'UNKNOWN' END AS session_type,
    CASE WHEN via > 2 THEN 'TERMINATING' ELSE 'ORIGINATING' END AS direction FROM g)"""


def _sessions(spark, sf):
    return C.sip_sessions(bound(spark, sf, "sip"), "call_id", ORDER)


@register("sip_sessions", check(_SIP + " SELECT * FROM calls", "sip"))
def _(spark, sf):
    return _sessions(spark, sf)


@register(
    "sip_statistics",
    check(
        _SIP + """ SELECT count(*) AS total_sessions, CAST(sum(messages) AS BIGINT) AS total_messages, count(*) FILTER (session_type IN ('REGISTRATION', 'DEREGISTRATION')) AS registrations,
        count(*) FILTER (session_type = 'VOICE_CALL') AS voice_calls, count(*) FILTER (session_type = 'VIDEO_CALL') AS video_calls, count(*) FILTER (session_type = 'SMS_MESSAGE') AS sms,
        count(*) FILTER (session_type IN ('EMERGENCY_CALL', 'UNKNOWN')) AS other, count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS active FROM calls""",
        "sip",
    ),
)
def _(spark, sf):
    return C.sip_statistics(_sessions(spark, sf))


@register(
    "sip_transactions",
    check(
        """SELECT via_branch, min_by(method, (ts, frame_number)) FILTER (is_request) AS method, count(*) FILTER (NOT is_request AND status_code BETWEEN 100 AND 199) AS provisional_responses,
        coalesce(string_agg(DISTINCT CASE WHEN status_code BETWEEN 100 AND 199 THEN CAST(status_code AS VARCHAR) END, ',' ORDER BY CASE WHEN status_code BETWEEN 100 AND 199 THEN CAST(status_code AS VARCHAR) END), '') AS provisional_codes,
        max_by(status_code, (ts, frame_number)) FILTER (status_code >= 200) AS final_code, (max(ts) - min(ts)) // 1000 AS duration_ms,
        CASE WHEN bool_or(status_code >= 200) THEN 'COMPLETED' WHEN bool_or(status_code >= 100) THEN 'PROCEEDING' ELSE 'TRYING' END AS state
        FROM sip GROUP BY via_branch""",
        "sip",
    ),
)
def _(spark, sf):
    return C.sip_transactions(bound(spark, sf, "sip"), "via_branch", ORDER)


_DIALOGS = """WITH f AS (SELECT call_id, from_tag, coalesce(min_by(to_tag, (ts, frame_number)) FILTER (to_tag <> ''), '') AS ft,
    greatest(count(DISTINCT nullif(to_tag, '')) - 1, 0) AS forks FROM sip GROUP BY 1, 2),
  n AS (SELECT s.* REPLACE (coalesce(nullif(s.to_tag, ''), ft) AS to_tag), forks FROM sip s JOIN f USING (call_id, from_tag)),
  d0 AS (SELECT call_id, from_tag, to_tag, min(ts) AS c, min(CASE WHEN NOT is_request AND status_code BETWEEN 200 AND 299 AND cseq_method = 'INVITE' THEN ts END) AS ok,
    bool_or(is_request AND method = 'BYE') AS bye, count(*) AS messages, max(forks) AS forks FROM n GROUP BY 1, 2, 3),
  d AS (SELECT call_id, from_tag, to_tag, CASE WHEN bye THEN 'TERMINATED' WHEN ok IS NOT NULL THEN 'CONFIRMED' ELSE 'EARLY' END AS state,
    (ok - c) // 1000 AS setup_ms, messages, forks FROM d0)"""


@register("sip_dialogs", check(_DIALOGS + " SELECT * FROM d", "sip"))
def _(spark, sf):
    return C.sip_dialogs(bound(spark, sf, "sip"), ORDER)


@register(
    "dialog_statistics",
    check(
        _DIALOGS + " SELECT state, count(*) AS dialogs, round(avg(setup_ms), 6) AS avg_setup_ms, CAST(sum(forks) AS BIGINT) AS forks FROM d GROUP BY state",
        "sip",
    ),
)
def _(spark, sf):
    stats = C.dialog_statistics(C.sip_dialogs(bound(spark, sf, "sip"), ORDER))
    return stats.withColumn("avg_setup_ms", F.round("avg_setup_ms", 6))


_KPIS = """WITH m AS (SELECT call_id, min(CASE WHEN is_request AND method = 'INVITE' THEN ts END) AS invite, min(CASE WHEN status_code = 180 THEN ts END) AS ringing,
    min(CASE WHEN status_code = 200 AND cseq_method = 'INVITE' THEN ts END) AS ok, min(CASE WHEN method = 'BYE' THEN ts END) AS bye FROM sip GROUP BY 1),
  kpi AS (SELECT call_id, CAST(trunc((ok - invite) / 1000) AS BIGINT) AS setup_time_ms, CAST(trunc((ringing - invite) / 1000) AS BIGINT) AS ring_time_ms, CAST(trunc((ok - ringing) / 1000) AS BIGINT) AS answer_delay_ms,
    CAST(trunc((bye - ok) / 1000) AS BIGINT) AS call_duration_ms FROM m)"""


@register("call_kpis", check(_KPIS + " SELECT * FROM kpi", "sip"))
def _(spark, sf):
    return C.call_kpis(bound(spark, sf, "sip"), "call_id", "ts")


def _event_sql() -> str:
    return """CASE WHEN protocol = 'RTP' THEN 'MEDIA' WHEN is_request AND method IN ('INVITE', 'ACK', 'BYE', 'CANCEL') THEN method
      WHEN status_code = 100 THEN 'TRYING' WHEN status_code IN (180, 183) THEN 'RINGING' WHEN status_code = 200 THEN 'OK' WHEN status_code >= 300 THEN 'FAILURE' END"""


_STATES = f"""WITH e AS (SELECT call_id, ts, frame_number, {_event_sql()} AS ev FROM sip),
  i AS (SELECT call_id, min((ts, frame_number)) AS first FROM e WHERE ev = 'INVITE' GROUP BY 1),
  a AS (SELECT e.*, row_number() OVER (PARTITION BY call_id ORDER BY ts, frame_number) AS n, lag(ev) OVER (PARTITION BY call_id ORDER BY ts, frame_number) AS p
    FROM e JOIN i USING (call_id) WHERE ev IS NOT NULL AND (ts, frame_number) >= first AND (ev <> 'INVITE' OR (ts, frame_number) = first)),
  m AS (SELECT * FROM a WHERE ev <> 'MEDIA' OR p = 'ACK'),
  s AS (SELECT call_id, CASE max_by(ev, (ts, frame_number)) WHEN 'INVITE' THEN 'INITIATING' WHEN 'TRYING' THEN 'TRYING' WHEN 'RINGING' THEN 'RINGING' WHEN 'OK' THEN 'ANSWERED'
    WHEN 'FAILURE' THEN 'FAILED' WHEN 'ACK' THEN 'CONFIRMED' WHEN 'BYE' THEN 'COMPLETED' WHEN 'CANCEL' THEN 'CANCELLED' WHEN 'MEDIA' THEN 'MEDIA_ACTIVE' END AS state,
    min(ts) AS start_ts, max(ts) AS state_ts FROM m GROUP BY 1)"""


def _states(spark, sf):
    rows = bound(spark, sf, "sip")
    return C.call_states(rows.withColumn("event", C.call_event()), "call_id", ORDER, F.col("event"))


@register("call_states", check(_STATES + " SELECT * FROM s", "sip"))
def _(spark, sf):
    return _states(spark, sf)


@register(
    "calls_of_party",
    check(_SIP + " SELECT call_id, caller, callee FROM calls WHERE session_type = 'VOICE_CALL' AND '+14150000013' IN (caller, callee)", "sip"),
)
def _(spark, sf):
    return C.calls_of(_sessions(spark, sf), ["caller", "callee"], "+14150000013", "VOICE_CALL").select("call_id", "caller", "callee")


_ROLE_RULES = """CASE WHEN protocol = 'S1AP' OR {p}_port = 36412 THEN '{a0}' WHEN {p}_port = 38412 THEN '{a1}' WHEN {p}_port = 8805 THEN '{a2}'
  WHEN message_type = 'GTP_CREATE_SESSION_REQ' THEN '{b0}' WHEN message_type = 'GTP_CREATE_SESSION_RESP' THEN '{b1}' WHEN message_type = 'SIP_REGISTER' THEN '{b2}'
  WHEN protocol = 'DIAMETER' AND application_id = 16777251 THEN '{c0}' WHEN protocol = 'DIAMETER' AND application_id = 16777238 THEN '{c1}'
  WHEN protocol = 'DIAMETER' AND application_id = 16777236 THEN '{c2}' WHEN protocol = 'DIAMETER' AND application_id = 16777217 THEN '{c3}' ELSE 'UNKNOWN' END"""
_SRC_ROLE = _ROLE_RULES.format(p="src", a0="ENODEB", a1="GNODEB", a2="SMF", b0="MME", b1="SGW", b2="UE", c0="MME", c1="PGW", c2="P-CSCF", c3="AS")
_DST_ROLE = _ROLE_RULES.format(p="dst", a0="MME", a1="AMF", a2="UPF", b0="SGW", b1="MME", b2="P-CSCF", c0="HSS", c1="PCRF", c2="PCRF", c3="HSS")
_PEOPLE = f"""WITH shown AS (SELECT user_id, ts, message_id, src_ip AS ip, src_port AS port, {_SRC_ROLE} AS role, 0 AS side FROM messages
    UNION ALL SELECT user_id, ts, message_id, dst_ip, dst_port, {_DST_ROLE}, 1 FROM messages),
  f AS (SELECT user_id, ip, min((ts, message_id, side)) AS place, min_by((role, port), (ts, message_id, side)) AS r FROM shown GROUP BY 1, 2),
  n AS (SELECT user_id, ip, r[1] AS role, r[2] AS port, row_number() OVER (PARTITION BY user_id, r[1] ORDER BY place, ip) AS nth FROM f),
  people AS (SELECT user_id, ip, role, CASE WHEN role = 'UNKNOWN' THEN 'UNKNOWN-' || ip || CASE WHEN port <> 0 THEN ':' || port ELSE '' END
    WHEN role = 'UE' OR nth = 1 THEN role ELSE role || '-' || CASE WHEN nth < 10 THEN '0' ELSE '' END || nth END AS participant FROM n)"""


def _people(spark, sf):
    rows = bound(spark, sf, "messages").select(
        "user_id", "ts", "message_id", "protocol", "message_type", "application_id", "src_ip", "src_port", "dst_ip", "dst_port"
    )
    return rows, D.participants(rows, ["user_id"], ["ts", "message_id"])


@register("diagram_participants", check(_PEOPLE + " SELECT * FROM people", "messages"))
def _(spark, sf):
    return _people(spark, sf)[1]


# Stated roles of addresses, some for one port only.
_STATED = """SELECT DISTINCT '192.168.' || CAST(s_suppkey % 40 AS STRING) || '.1' AS ip, 'NF' || CAST(s_suppkey % 7 AS STRING) AS role,
    CASE WHEN s_suppkey % 3 > 0 THEN 5060 + s_suppkey % 2 END AS port FROM {supplier}"""
_MAPPED = _PEOPLE.replace(
    "n AS (SELECT user_id, ip, r[1] AS role, r[2] AS port, row_number() OVER (PARTITION BY user_id, r[1] ORDER BY place, ip) AS nth FROM f)",
    f"""stated AS ({_STATED.replace("{supplier}", "supplier")}),
  at_port AS (SELECT ip, port, min(role) AS role FROM stated WHERE port IS NOT NULL GROUP BY 1, 2),
  at_ip AS (SELECT ip, role FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY coalesce(port, 0), role) AS k FROM stated) WHERE k = 1),
  g AS (SELECT f.user_id, f.ip, f.place, f.r, coalesce(p.role, a.role, f.r[1]) AS role FROM f
    LEFT JOIN at_port p ON p.ip = f.ip AND p.port = f.r[2] LEFT JOIN at_ip a ON a.ip = f.ip),
  n AS (SELECT user_id, ip, role, r[2] AS port, row_number() OVER (PARTITION BY user_id, role ORDER BY place, ip) AS nth FROM g)""",
)


@register("diagram_stated_participants", check(_MAPPED + " SELECT * FROM people", "messages"))
def _(spark, sf):
    stated = spark.sql(_STATED, supplier=table(spark, sf, "supplier"))
    return D.participants(_people(spark, sf)[0], ["user_id"], ["ts", "message_id"], stated)


_ROWS = _PEOPLE + """, rows_ AS (SELECT m.user_id, m.ts, m.message_id, row_number() OVER (PARTITION BY m.user_id ORDER BY m.ts, m.message_id) AS event_no,
    a.participant AS sender, b.participant AS receiver, m.message_type, CASE m.protocol WHEN 'S1AP' THEN 'S1-MME' WHEN 'SIP' THEN 'IMS' WHEN 'RTP' THEN 'IMS'
      WHEN 'GTP_C' THEN CASE WHEN (a.role, b.role) IN (('MME', 'SGW'), ('SGW', 'MME')) THEN 'S11' WHEN (a.role, b.role) IN (('SGW', 'PGW'), ('PGW', 'SGW')) THEN 'S5/S8' ELSE 'GTP-C' END
      ELSE CASE application_id WHEN 16777251 THEN 'S6a' WHEN 16777238 THEN 'Gx' WHEN 16777236 THEN 'Rx' WHEN 16777217 THEN 'Sh' ELSE 'DIAMETER' END END AS label
  FROM messages m JOIN people a ON m.user_id = a.user_id AND m.src_ip = a.ip JOIN people b ON m.user_id = b.user_id AND m.dst_ip = b.ip)"""


@register("diagram_rows", check(_ROWS + " SELECT * FROM rows_", "messages"))
def _(spark, sf):
    rows, people = _people(spark, sf)
    return D.diagram_rows(rows, people, ["user_id"], ["ts", "message_id"])


@register(
    "diagram_lanes",
    check(_ROWS + " SELECT user_id, label, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM rows_ GROUP BY 1, 2", "messages"),
)
def _(spark, sf):
    rows, people = _people(spark, sf)
    return D.lanes(D.diagram_rows(rows, people, ["user_id"], ["ts", "message_id"]), ["user_id"], "label", ["ts", "message_id"])


# SIP messages by charging id, with method or status and reason.
_SIP_ONLY = """SELECT icid, ts, message_id, src_ip, src_port, dst_ip, dst_port, CASE message_type WHEN 'SIP_INVITE' THEN 'INVITE' WHEN 'SIP_REGISTER' THEN 'REGISTER' WHEN 'SIP_BYE' THEN 'BYE' END AS method,
    CASE message_type WHEN 'SIP_TRYING' THEN 100 WHEN 'SIP_RINGING' THEN 180 WHEN 'SIP_OK' THEN 200 END AS status_code,
    CASE message_type WHEN 'SIP_TRYING' THEN 'Trying' WHEN 'SIP_OK' THEN 'OK' END AS reason FROM {messages} WHERE protocol = 'SIP'"""
_SIP_ENDS = f"""WITH m AS ({_SIP_ONLY.replace("{messages}", "messages")}),
  e AS (SELECT icid, src_ip AS ip, src_port AS port FROM m UNION SELECT icid, dst_ip, dst_port FROM m),
  people AS (SELECT icid, ip, port, 'p' || (row_number() OVER (PARTITION BY icid ORDER BY ip, port) - 1) AS participant,
    CASE WHEN port IN (5060, 5061) THEN 'SIP-' ELSE 'UE-' END || split_part(ip, '.', -1) AS label, CASE WHEN port IN (5060, 5061) THEN 'proxy' ELSE 'endpoint' END AS kind FROM e)"""


def _sip_only(spark, sf):
    return spark.sql(_SIP_ONLY, messages=bound(spark, sf, "messages"))


@register("sip_only_participants", check(_SIP_ENDS + " SELECT * FROM people", "messages"))
def _(spark, sf):
    return D.sip_participants(_sip_only(spark, sf), ["icid"])


@register(
    "sip_only_diagram_rows",
    check(
        _SIP_ENDS + """ SELECT m.icid, ts, message_id, row_number() OVER (PARTITION BY m.icid ORDER BY ts, message_id) - 1 AS message_no, a.participant AS sender, b.participant AS receiver,
        coalesce(method, CAST(status_code AS VARCHAR)) AS message, coalesce(method, status_code || coalesce(' ' || reason, '')) AS label
        FROM m JOIN people a ON m.icid = a.icid AND src_ip = a.ip AND src_port = a.port JOIN people b ON m.icid = b.icid AND dst_ip = b.ip AND dst_port = b.port""",
        "messages",
    ),
)
def _(spark, sf):
    rows = _sip_only(spark, sf)
    return D.sip_rows(rows, D.sip_participants(rows, ["icid"]), ["icid"], ["ts", "message_id"])


@register(
    "calls_of_frame",
    check(
        "SELECT call_id, count(*) AS frames, min(frame_number) AS first_frame FROM sip WHERE call_id IN (SELECT call_id FROM sip WHERE frame_number IN (17, 42, 99)) GROUP BY 1",
        "sip",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "sip").select("call_id", "frame_number")
    hit = FI.having_child(rows, rows, "call_id", F.col("frame_number").isin(17, 42, 99))
    return hit.groupBy("call_id").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_number").alias("first_frame"))
