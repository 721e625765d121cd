"""Join, as-of, interval and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, phones
from ..operators import asof as A
from ..operators import calls as C
from ..operators import filters as FI
from ..operators import matching as M
from ..operators import media as ME
from ..operators import tunnels as T
from ..operators.components import key_rows
from .bindings import bound, check, table
from .registry import register


@register(
    "message_session_detail",
    check(
        """SELECT l.session_id, l.l_linenumber, l.l_partkey, l.interface, l.ts, s.session_type, s.start_ts
        FROM leg_messages l JOIN call_sessions s USING (session_id)""",
        "leg_messages", "call_sessions",
    ),
)
def _(spark, sf):
    sessions = bound(spark, sf, "call_sessions").select("session_id", "session_type", "start_ts")
    return bound(spark, sf, "leg_messages").select("session_id", "l_linenumber", "l_partkey", "interface", "ts").join(sessions, "session_id")


@register(
    "session_summary",
    check(
        """WITH m AS (SELECT session_id, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes FROM leg_messages GROUP BY 1),
        l AS (SELECT session_id, count(DISTINCT interface) AS legs FROM leg_messages GROUP BY 1)
        SELECT s.session_id, s.session_type, coalesce(messages, 0) AS messages, coalesce(bytes, 0) AS bytes, coalesce(legs, 0) AS legs
        FROM call_sessions s LEFT JOIN m USING (session_id) LEFT JOIN l USING (session_id)""",
        "call_sessions", "leg_messages",
    ),
)
def _(spark, sf):
    """Children are aggregated before the join, so a session's counts are not multiplied by its legs."""
    per_leg = bound(spark, sf, "leg_messages").groupBy("session_id", "interface").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes")
    )
    children = per_leg.groupBy("session_id").agg(
        F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("legs")
    )
    sessions = bound(spark, sf, "call_sessions").select("session_id", "session_type")
    return sessions.join(children, "session_id", "left").na.fill(0, ["messages", "bytes", "legs"])


@register(
    "sessions_of_jobs_in_range",
    check(
        """SELECT protocol, count(*) AS sessions FROM job_sessions WHERE job_id IN (SELECT job_id FROM jobs
        WHERE created_ts BETWEEN epoch_us(TIMESTAMP '1996-01-01 00:00:00') AND epoch_us(TIMESTAMP '1996-12-31 00:00:00')) GROUP BY protocol""",
        "job_sessions", "jobs",
    ),
)
def _(spark, sf):
    jobs = FI.matching(
        bound(spark, sf, "jobs"),
        created_ts=(F.expr("TIMESTAMP '1996-01-01 00:00:00'"), F.expr("TIMESTAMP '1996-12-31 00:00:00'")),
    )
    kept = bound(spark, sf, "job_sessions").join(jobs.select("job_id"), "job_id", "left_semi")
    return kept.groupBy("protocol").agg(F.count(F.lit(1)).alias("sessions"))


def _session_keys(spark, sf):
    """Keys of the user's sessions: here one session per user."""
    rows = bound(spark, sf, "messages").withColumn("session_id", F.col("user_id"))
    keys = {
        "imsi": F.col("imsi"), "msisdn": F.col("msisdn"), "ue_ip/v4": F.col("ue_ipv4"), "ue_ip/v6": F.col("ue_ipv6"),
        "teid/s1u": F.col("teid"), "icid": F.col("icid"),
    }
    return key_rows(rows, "session_id", keys).distinct()


_KEYS = """WITH kk AS (SELECT DISTINCT user_id AS session_id, unnest(['imsi', 'msisdn', 'ue_ip', 'ue_ip', 'teid', 'icid']) AS key_type,
    unnest([imsi, msisdn, ue_ipv4, ue_ipv6, CAST(teid AS VARCHAR), icid]) AS key_value FROM messages),
  keys AS (SELECT * FROM kk WHERE key_value IS NOT NULL)"""


@register("session_keys", check(_KEYS + " SELECT * FROM keys", "messages"))
def _(spark, sf):
    return _session_keys(spark, sf)


@register(
    "sessions_by_identifier",
    check(
        _KEYS + """, w AS (SELECT DISTINCT key_type, key_value FROM keys WHERE key_type IN ('msisdn', 'imsi'))
        SELECT DISTINCT key_type, key_value, session_id FROM keys JOIN w USING (key_type, key_value)""",
        "messages",
    ),
)
def _(spark, sf):
    keys = _session_keys(spark, sf)
    wanted = keys.filter(F.col("key_type").isin("msisdn", "imsi")).select("key_type", "key_value")
    return FI.sessions_by_key(keys, wanted)


@register(
    "messages_of_subscriber",
    check(
        _KEYS + """ SELECT message_id, ts, protocol FROM messages WHERE user_id IN (SELECT session_id FROM keys
        WHERE key_type = 'msisdn' AND key_value = '14150000003')""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").withColumn("session_id", F.col("user_id"))
    found = FI.messages_of_key(messages, _session_keys(spark, sf), "msisdn", "14150000003", "session_id", ["ts", "message_id"])
    return found.select("message_id", "ts", "protocol")


_CLAIMS = """WITH claims AS (SELECT ts, message_id, imsi, unnest([ue_ipv4, src_ip]) AS ip FROM messages WHERE protocol = 'GTP_C'),
  probes AS (SELECT ts, message_id, unnest([1, 2, 3, 4]) AS rank, unnest([ue_ipv4, ue_ipv6, src_ip, dst_ip]) AS ip FROM messages WHERE protocol = 'SIP'),
  hits AS (SELECT p.message_id, p.rank, (SELECT max_by(c.imsi, (c.ts, c.message_id)) FROM claims c WHERE c.ip = p.ip AND c.ts <= p.ts) AS imsi
    FROM probes p WHERE p.ip IS NOT NULL)"""


@register(
    "address_owner_as_of",
    check(_CLAIMS + " SELECT message_id, min_by(imsi, rank) AS imsi FROM hits WHERE imsi IS NOT NULL GROUP BY message_id", "messages"),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").withColumn("at", F.unix_micros("ts"))
    claims = messages.filter("protocol = 'GTP_C'").select("at", "message_id", "imsi", F.explode(F.array("ue_ipv4", "src_ip")).alias("ip"))
    probes = messages.filter("protocol = 'SIP'").select("message_id", "at", "ue_ipv4", "ue_ipv6", "src_ip", "dst_ip")
    order = [F.col(c) for c in ("ue_ipv4", "ue_ipv6", "src_ip", "dst_ip")]
    return A.first_by_precedence(
        probes, claims.filter("ip is not null"), "message_id", order, F.col("at"), "ip", F.col("at"), "message_id", "imsi"
    )


@register(
    "phone_owner_as_of",
    check(
        """WITH c AS (SELECT msisdn, imsi, ts, message_id FROM messages WHERE imsi IS NOT NULL AND msisdn IS NOT NULL),
        p AS (SELECT message_id, ts, msisdn FROM messages WHERE imsi IS NULL AND msisdn IS NOT NULL),
        h AS (SELECT p.message_id, (SELECT max_by(c.imsi, (c.ts, c.message_id)) FROM c WHERE c.msisdn = p.msisdn AND c.ts <= p.ts) AS imsi FROM p)
        SELECT * FROM h WHERE imsi IS NOT NULL""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").withColumn("at", F.unix_micros("ts")).select("message_id", "at", "imsi", "msisdn")
    claims = messages.filter("imsi is not null and msisdn is not null")
    probes = messages.filter("imsi is null and msisdn is not null").drop("imsi")
    return A.first_by_precedence(
        probes, claims, "message_id", [F.col("msisdn")], F.col("at"), "msisdn", F.col("at"), "message_id", "imsi"
    )


@register(
    "last_signup_before_purchase",
    """WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'),
      s AS (SELECT event_id AS claim_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'signup')
    SELECT p.event_id, p.user_id, s.claim_id, p.at - s.at AS age_us FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.at >= s.at""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros("ts").alias("at"), "event_type")
    probes = events.filter("event_type = 'purchase'").drop("event_type")
    claims = events.filter("event_type = 'signup'").drop("event_type")
    found = A.asof_join(probes, claims, ["user_id"], F.col("at"), F.col("at"), "event_id")
    return found.select(
        "event_id", "user_id", F.col("claim.event_id").alias("claim_id"), (F.col("at") - F.col("claim.at")).alias("age_us")
    )


@register(
    "port_claims_with_ttl",
    check(
        """WITH p AS (SELECT message_id, src_port - 20000 AS port, ts FROM messages WHERE protocol = 'RTP'),
        k AS (SELECT user_id % 100 AS port, ts, message_id, icid FROM messages WHERE protocol = 'SIP'),
        h AS (SELECT p.message_id, p.ts, (SELECT max_by((k.ts, k.icid), (k.ts, k.message_id)) FROM k WHERE k.port = p.port AND k.ts <= p.ts) AS r FROM p)
        SELECT message_id, CASE WHEN ts - r[1] <= 21600000000 THEN r[2] END AS call_id FROM h""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").withColumn("at", F.unix_micros("ts"))
    probes = messages.filter("protocol = 'RTP'").select("message_id", (F.col("src_port") - 20000).cast("bigint").alias("port"), "at")
    claims = messages.filter("protocol = 'SIP'").select((F.col("user_id") % 100).alias("port"), "at", "message_id", "icid")
    found = A.claims_within(probes, claims, ["port"], F.col("at"), F.col("at"), "message_id", 21_600_000_000)
    return found.select("message_id", F.col("claim.icid").alias("call_id"))


# Windows: purchases with two hours to go; legs: errors of the same user.
_WINDOWS = """WITH w AS (SELECT user_id, message_id AS call_id, ts AS start_ts, ts + 7200000000 AS end_ts FROM messages WHERE protocol = 'RTP'),
  l AS (SELECT user_id, message_id AS leg_id, ts AS s, ts + payload_length * 1000000 AS e FROM messages WHERE protocol = 'S1AP'),
  c AS (SELECT leg_id, call_id, row_number() OVER (PARTITION BY leg_id ORDER BY start_ts, call_id) AS n FROM l JOIN w USING (user_id)
    WHERE {hit})
  SELECT leg_id, call_id FROM c WHERE n = 1"""


def _windows(spark, sf):
    messages = bound(spark, sf, "messages")
    windows = messages.filter("protocol = 'RTP'").selectExpr(
        "user_id", "message_id AS call_id", "ts AS start_ts", "timestamp_micros(unix_micros(ts) + 7200000000) AS end_ts"
    )
    legs = messages.filter("protocol = 'S1AP'").selectExpr(
        "user_id", "message_id AS leg_id", "ts AS s", "timestamp_micros(unix_micros(ts) + payload_length * 1000000) AS e"
    )
    return windows, legs


@register(
    "legs_claimed_within_tolerance",
    check(_WINDOWS.format(hit="s BETWEEN start_ts - 1800000000 AND end_ts + 1800000000"), "messages"),
)
def _(spark, sf):
    windows, legs = _windows(spark, sf)
    return A.earliest_claim(legs, windows, ["user_id"], "leg_id", "s", "s", "call_id", "start_ts", "end_ts", 1_800_000_000)


@register("overlapping_sessions_attached", check(_WINDOWS.format(hit="end_ts >= s AND start_ts <= e"), "messages"))
def _(spark, sf):
    windows, legs = _windows(spark, sf)
    return A.earliest_claim(legs, windows, ["user_id"], "leg_id", "s", "e", "call_id", "start_ts", "end_ts")


_MEDIA = """WITH st AS (SELECT message_id AS stream_id, src_ip, src_port % 3 AS src_port, dst_ip, dst_port % 2 AS dst_port, ts AS start_ts, ts + 3600000000 AS end_ts
    FROM messages WHERE protocol = 'RTP'),
  md AS (SELECT message_id AS call_id, src_ip AS ue_ip, k % 3 AS ue_port, dst_ip AS net_ip, dst_port % 2 AS net_port, ts - 86400000000 AS start_ts, ts + 86400000000 AS end_ts
    FROM messages WHERE protocol <> 'RTP')"""


def _media(spark, sf):
    messages = bound(spark, sf, "messages")
    streams = messages.filter("protocol = 'RTP'").selectExpr(
        "message_id AS stream_id", "src_ip", "src_port % 3 AS src_port", "dst_ip", "dst_port % 2 AS dst_port", "ts AS start_ts",
        "ts + interval 1 hour AS end_ts",
    )
    media = messages.filter("protocol <> 'RTP'").selectExpr(
        "message_id AS call_id", "src_ip AS ue_ip", "k % 3 AS ue_port", "dst_ip AS net_ip", "dst_port % 2 AS net_port",
        "ts - interval 1 day AS start_ts", "ts + interval 1 day AS end_ts",
    )
    return streams, media


@register(
    "stream_direction",
    check(
        _MEDIA + """, sides AS (SELECT call_id, 'UPLINK' AS direction, ue_ip AS si, ue_port AS sp, net_ip AS di, net_port AS dp, start_ts AS f, end_ts AS t FROM md
          UNION ALL SELECT call_id, 'DOWNLINK', net_ip, net_port, ue_ip, ue_port, start_ts, end_ts FROM md),
        c AS (SELECT stream_id, call_id, direction, row_number() OVER (PARTITION BY stream_id ORDER BY f, call_id, direction) AS n FROM st JOIN sides
          ON src_ip = si AND src_port = sp AND dst_ip = di AND dst_port = dp AND start_ts <= t AND end_ts >= f)
        SELECT stream_id, call_id, direction FROM c WHERE n = 1""",
        "messages",
    ),
)
def _(spark, sf):
    streams, media = _media(spark, sf)
    return ME.stream_direction(streams, media)


@register(
    "streams_by_address",
    check(
        _MEDIA + """, a AS (SELECT DISTINCT ue_ip AS address FROM md WHERE ue_port = 1),
        e AS (SELECT stream_id, src_ip AS address, 'SENDER' AS role, start_ts, end_ts FROM st UNION ALL SELECT stream_id, dst_ip, 'RECEIVER', start_ts, end_ts FROM st)
        SELECT stream_id, address, role FROM e JOIN a USING (address)
        WHERE end_ts >= epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND start_ts <= epoch_us(TIMESTAMP '2024-01-25 00:00:00')""",
        "messages",
    ),
)
def _(spark, sf):
    streams, media = _media(spark, sf)
    inside = ME.streams_in_window(streams, F.expr("TIMESTAMP '2024-01-05 00:00:00'"), F.expr("TIMESTAMP '2024-01-25 00:00:00'"))
    found = ME.streams_of_address(inside, media.filter("ue_port = 1").select(F.col("ue_ip").alias("address")))
    return found.select("stream_id", "address", "role")


@register(
    "packet_owner",
    check(
        """WITH e AS (SELECT src_ip AS ip, k % 4 AS teid, min(message_id) AS session FROM messages WHERE protocol = 'GTP_C' GROUP BY 1, 2)
        SELECT m.message_id, coalesce(d.session, s.session) AS session FROM messages m
        LEFT JOIN e d ON m.dst_ip = d.ip AND m.k % 4 = d.teid LEFT JOIN e s ON m.src_ip = s.ip AND m.k % 4 = s.teid""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").withColumn("teid", F.col("k") % 4)
    ends = messages.filter("protocol = 'GTP_C'").groupBy(F.col("src_ip").alias("ip"), "teid").agg(F.min("message_id").alias("session"))
    return T.packet_owner(messages.select("message_id", "src_ip", "dst_ip", "teid"), ends, ["session"]).select("message_id", "session")


@register(
    "diameter_attached_to_calls",
    check(
        """WITH c AS (SELECT message_id AS call_id, imsi, icid, ts AS start_ts, ts + 86400000000 AS end_ts FROM messages WHERE protocol = 'SIP'),
        m AS (SELECT message_id, CASE WHEN k % 3 = 0 THEN 'icid-' || user_id || '-' || k % 10 END AS icid,
          '310260' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS imsi, ts FROM messages WHERE protocol = 'DIAMETER'),
        i AS (SELECT message_id, min(call_id) AS call_id, 'ICID' AS how FROM m JOIN c USING (icid) GROUP BY message_id),
        o AS (SELECT message_id, call_id, 'SUBSCRIBER' AS how, row_number() OVER (PARTITION BY message_id ORDER BY start_ts, call_id) AS n
          FROM m JOIN c USING (imsi) WHERE m.ts BETWEEN start_ts AND end_ts AND message_id NOT IN (SELECT message_id FROM i))
        SELECT * FROM i UNION ALL SELECT message_id, call_id, how FROM o WHERE n = 1""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages")
    calls = messages.filter("protocol = 'SIP'").selectExpr(
        "message_id AS call_id", "imsi", "icid", "ts AS start_ts", "ts + interval 1 day AS end_ts"
    )
    diameter = messages.filter("protocol = 'DIAMETER'").selectExpr(
        "message_id", "CASE WHEN k % 3 = 0 THEN 'icid-' || user_id || '-' || (k % 10) END AS icid",
        "'310260' || lpad(user_id, 9, '0') AS imsi", "ts",
    )
    return C.attach_by_icid_or_subscriber(diameter, calls, "message_id", "ts")


@register(
    "bearers_attached_to_calls",
    check(
        """WITH c AS (SELECT message_id AS call_id, imsi, ts AS start_ts, ts + 86400000000 AS end_ts FROM messages WHERE protocol = 'SIP' AND imsi IS NOT NULL),
        b AS (SELECT message_id, imsi, ts FROM messages WHERE message_type = 'S1AP_INITIAL_UE_MESSAGE' OR message_type LIKE 'GTP%REQ'),
        ev AS (SELECT *, row_number() OVER (PARTITION BY imsi ORDER BY pos, side, id) AS n FROM (
          SELECT imsi, start_ts AS pos, 0 AS side, call_id AS id, end_ts FROM c UNION ALL SELECT imsi, ts, 1, message_id, NULL FROM b)),
        walk(imsi, n, free, message_id, call_id) AS (
          SELECT DISTINCT imsi, 0::BIGINT, []::STRUCT(call_id BIGINT, until BIGINT)[], NULL::BIGINT, NULL::BIGINT FROM ev UNION ALL
          SELECT imsi, n, CASE WHEN side = 0 THEN list_append(free, {'call_id': id, 'until': end_ts}) ELSE live[2:] END, CASE WHEN side = 1 THEN id END, CASE WHEN side = 1 THEN live[1].call_id END
          FROM (SELECT w.imsi, e.n, e.side, e.id, e.end_ts, w.free, list_filter(w.free, lambda x: x.until >= e.pos) AS live FROM walk w JOIN ev e ON e.imsi = w.imsi AND e.n = w.n + 1))
        SELECT message_id, call_id FROM walk WHERE call_id IS NOT NULL""",
        "messages", recursive=True,
    ),
)
def _(spark, sf):
    """Bearer requests and calls of subscribers; a call takes one bearer."""
    messages = bound(spark, sf, "messages")
    calls = messages.filter("protocol = 'SIP'").selectExpr("message_id AS call_id", "imsi", "ts AS start_ts", "ts + interval 1 day AS end_ts")
    requests = messages.filter("message_type = 'S1AP_INITIAL_UE_MESSAGE' or message_type like 'GTP%REQ'").select("message_id", "imsi", "ts")
    return C.attach_bearers(requests, calls, "message_id", "ts")


_PHONES = """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '44' ELSE '' END AS country,
    '4155' || lpad(CAST(c_custkey % 400 AS VARCHAR), 6, '0') AS national FROM customer),
  n AS (SELECT DISTINCT country || national AS digits, national FROM c),
  s AS (SELECT DISTINCT CASE s_suppkey % 2 WHEN 0 THEN '1' ELSE '' END || '4155' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS digits,
    '4155' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS national FROM supplier)"""


def _phone_frames(spark, sf):
    numbers = table(spark, sf, "customer").select(
        phones.phone_number(
            F.expr("CASE c_custkey % 3 WHEN 0 THEN 'tel:+1' WHEN 1 THEN 'tel:+44' ELSE 'tel:' END || '4155' || lpad(c_custkey % 400, 6, '0')")
        ).alias("phone")
    )
    probes = table(spark, sf, "supplier").select(
        phones.phone_number(F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'tel:+1' ELSE 'tel:' END || '4155' || lpad(s_suppkey, 6, '0')")).alias("phone")
    )
    return numbers, probes


@register(
    "fuzzy_phone_matches",
    _PHONES + """ SELECT s.digits AS probe, n.digits AS number, CASE WHEN s.digits = n.digits THEN 'international'
      WHEN s.national = n.national THEN 'national' ELSE 'suffix' END AS how FROM s JOIN n
      ON s.digits = n.digits OR s.national = n.national OR right(s.digits, 9) = right(n.digits, 9)""",
)
def _(spark, sf):
    numbers, probes = _phone_frames(spark, sf)
    return M.number_matches(numbers, probes)


@register(
    "phone_containment_matches",
    """WITH n AS (SELECT DISTINCT '4155' || lpad(CAST(c_custkey % 400 AS VARCHAR), 6, '0') AS digits FROM customer),
      s AS (SELECT DISTINCT '55' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS digits FROM supplier)
    SELECT s.digits AS probe, n.digits AS number, 'containment' AS how FROM s JOIN n ON contains(n.digits, s.digits)""",
)
def _(spark, sf):
    numbers = table(spark, sf, "customer").select(phones.phone_number(F.expr("'tel:4155' || lpad(c_custkey % 400, 6, '0')")).alias("phone"))
    probes = table(spark, sf, "supplier").select(phones.phone_number(F.expr("'tel:55' || lpad(s_suppkey, 6, '0')")).alias("phone"))
    return M.number_matches(numbers, probes, containment=True)


_SUBJECT = (
    "CASE WHEN {id} % 2 = 0 THEN '310260' || lpad(CAST({v} AS STRING), 9, '0') END AS imsi, "
    "CASE WHEN {id} % 3 = 0 THEN '35' || lpad(CAST({v} * 10 AS STRING), 12, '0') END AS imei, '310' AS mcc, '260' AS mnc, "
    "CASE WHEN {id} % 7 = 0 THEN {v} % 11 END AS mme_group_id, CASE WHEN {id} % 5 = 0 THEN {v} * 3 END AS tmsi, "
    "CASE WHEN {id} % 4 < 2 THEN CASE WHEN {id} % 8 < 4 THEN '1' ELSE '' END || '415' || lpad(CAST({v} AS STRING), 7, '0') END AS digits, "
    "CASE WHEN {id} % 4 < 2 THEN CASE WHEN {id} % 9 < 3 THEN '5' ELSE '415' END || lpad(CAST({v} AS STRING), 7, '0') END AS national, "
    "CASE WHEN {id} % 4 < 2 THEN CASE WHEN {id} % 8 < 4 THEN '1' ELSE '' END || '415' || lpad(CAST({v} AS STRING), 7, '0') END AS international, "
    "'10.0.' || CAST({v} % 50 AS STRING) || '.' || CAST({v} % 9 AS STRING) AS ipv4, "
    "CASE WHEN {id} % 3 <> 1 THEN '2001:db8:' || CAST({v} % 40 AS STRING) || ':' || CAST({v} % 7 AS STRING) || ':0:0:0:' || CAST({id} % 5 AS STRING) END AS ipv6, "
    "CASE {id} % 3 WHEN 0 THEN 'ims' ELSE 'internet' END AS apn, CASE WHEN {id} % 6 = 1 THEN {v} END AS teid"
)
_REGISTRY = _SUBJECT.format(id="c_custkey", v="c_custkey % 800")
_PREFIX = "array_to_string(string_split(ipv6, ':')[1:4], ':')"
_PROBE = _SUBJECT.format(id="(s_suppkey + 1)", v="s_suppkey * 5 % 900")


@register(
    "registry_best_match",
    f"""WITH r0 AS (SELECT c_custkey AS entity_id, {_REGISTRY} FROM customer), r AS (SELECT *, {_PREFIX} AS prefix FROM r0),
    p0 AS (SELECT s_suppkey AS probe_id, {_PROBE} FROM supplier), p AS (SELECT *, {_PREFIX} AS prefix FROM p0),
    w AS (SELECT probe_id, entity_id, unnest([CASE WHEN p.imsi = r.imsi THEN 1 END, CASE WHEN p.imei = r.imei THEN 2 END,
      CASE WHEN substr(p.imei, 1, 8) = substr(r.imei, 1, 8) THEN 3 END, CASE WHEN p.tmsi = r.tmsi AND p.mcc = r.mcc AND p.mnc = r.mnc THEN 4 END,
      CASE WHEN p.mme_group_id = r.mme_group_id AND p.mcc = r.mcc AND p.mnc = r.mnc THEN 5 END, CASE WHEN p.tmsi = r.tmsi THEN 6 END,
      CASE WHEN p.international = r.international THEN 7 END, CASE WHEN p.national = r.national THEN 8 END,
      CASE WHEN length(p.digits) >= 9 AND right(p.digits, 9) = right(r.digits, 9) THEN 9 END,
      CASE WHEN length(p.national) > 6 AND length(r.national) > 6 AND (contains(p.national, r.national) OR contains(r.national, p.national)) THEN 10 END,
      CASE WHEN length(p.digits) >= 7 AND right(p.digits, 7) = right(r.digits, 7) THEN 11 END,
      CASE WHEN (p.ipv4 = r.ipv4 OR p.ipv6 = r.ipv6 OR p.prefix = r.prefix) AND p.apn = r.apn THEN 12 END, CASE WHEN p.teid = r.teid THEN 13 END,
      CASE WHEN p.ipv4 = r.ipv4 OR p.ipv6 = r.ipv6 THEN 14 END, CASE WHEN p.prefix = r.prefix THEN 15 END]) AS rank FROM p, r),
    s AS (SELECT *, [1.0, 1.0, 0.3, 1.0, 0.4, 0.7, 1.0, 0.95, 0.8, 0.8, 0.6, 0.9, 0.85, 0.75, 0.5][rank] AS score FROM w WHERE rank IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, rank, entity_id) AS n FROM s)
    SELECT probe_id, entity_id, ['imsi', 'imei', 'imei_tac', 'guti', 'guti_pool', 'tmsi', 'msisdn', 'msisdn_national', 'msisdn_suffix9',
      'msisdn_contained', 'msisdn_suffix7', 'ip_apn', 'teid', 'ip', 'ip_prefix'][rank] AS how, CAST(score AS DOUBLE) AS score,
      CASE WHEN score >= 0.95 THEN 'EXACT' WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' WHEN score >= 0.3 THEN 'LOW' ELSE 'NONE' END AS confidence
    FROM b WHERE n = 1""",
)
def _(spark, sf):
    registry = table(spark, sf, "customer").selectExpr("c_custkey AS entity_id", *_split(_REGISTRY))
    probes = table(spark, sf, "supplier").selectExpr("s_suppkey AS probe_id", *_split(_PROBE))
    return M.match_registry(probes, registry, "probe_id", "entity_id")


def _split(text: str) -> list[str]:
    """Select list at its top-level commas."""
    parts, depth = [""], 0
    for mark in text:
        depth += (mark == "(") - (mark == ")")
        if mark == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += mark
    return parts


@register(
    "identity_pair_scores",
    f"""WITH r0 AS (SELECT c_custkey AS id, {_REGISTRY} FROM customer), r AS (SELECT *, {_PREFIX} AS prefix FROM r0),
    p0 AS (SELECT o_orderkey AS order_id, o_custkey AS id, {_SUBJECT.format(id="(o_custkey + 1)", v="o_orderkey % 900")} FROM orders), p AS (SELECT *, {_PREFIX} AS prefix FROM p0),
    f AS (SELECT order_id, CASE WHEN p.imsi = r.imsi THEN 1.0 ELSE 0.0 END AS a, CASE WHEN p.imei = r.imei THEN 1.0 WHEN substr(p.imei, 1, 8) = substr(r.imei, 1, 8) THEN 0.3 ELSE 0.0 END AS b,
      CASE WHEN p.tmsi = r.tmsi THEN 1.0 WHEN p.mme_group_id = r.mme_group_id THEN 0.4 ELSE 0.0 END AS c,
      CASE WHEN p.international = r.international THEN 1.0 WHEN p.national = r.national THEN 0.95
        WHEN right(p.digits, 9) = right(r.digits, 9) OR (length(p.national) > 6 AND length(r.national) > 6 AND (contains(p.national, r.national) OR contains(r.national, p.national))) THEN 0.8 WHEN right(p.digits, 7) = right(r.digits, 7) THEN 0.6 ELSE 0.0 END AS d,
      CASE WHEN (p.ipv4 = r.ipv4 OR p.ipv6 = r.ipv6 OR p.prefix = r.prefix) AND p.apn = r.apn THEN 0.9 ELSE 0.0 END AS e, CASE WHEN p.teid = r.teid THEN 0.85 ELSE 0.0 END AS f,
      CASE WHEN p.ipv4 = r.ipv4 OR p.ipv6 = r.ipv6 THEN 0.75 WHEN p.prefix = r.prefix THEN 0.5 ELSE 0.0 END AS g FROM p JOIN r USING (id))
    SELECT order_id, coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0), nullif(d, 0), nullif(e, 0), nullif(f, 0), g) AS cascade, greatest(a, b, c, d, e, f, g) AS best FROM f""",
)
def _(spark, sf):
    left = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS order_id", "o_custkey AS id", *_split(_SUBJECT.format(id="(o_custkey + 1)", v="o_orderkey % 900"))
    )
    right = table(spark, sf, "customer").selectExpr("c_custkey AS id", *_split(_REGISTRY))
    pairs = left.select("order_id", "id", F.struct(*[c for c in left.columns if c not in ("order_id", "id")]).alias("l")).join(
        right.select("id", F.struct(*[c for c in right.columns if c != "id"]).alias("r")), "id"
    )
    cascade, best = M.identity_score("l", "r")
    return pairs.select("order_id", cascade.alias("cascade"), best.alias("best"))


@register(
    "ipv6_prefix_matches",
    check(
        """WITH a AS (SELECT DISTINCT message_id, array_to_string(string_split(ue_ipv6, ':')[1:4], ':') AS prefix FROM messages WHERE ue_ipv6 IS NOT NULL)
        SELECT prefix, count(*) AS messages FROM a GROUP BY prefix""",
        "messages",
    ),
)
def _(spark, sf):
    prefix = identifiers.ipv6_prefix("ue_ipv6")
    rows = bound(spark, sf, "messages").select(prefix.alias("prefix")).filter("prefix is not null")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("messages"))


@register(
    "user_address_owners",
    check(
        """WITH k AS (SELECT message_id, user_id, event_type, ue_ipv4 AS a4, array_to_string(string_split(ue_ipv6, ':')[1:4], ':') AS a6 FROM messages),
        o AS (SELECT DISTINCT user_id, a FROM (SELECT user_id, unnest([a4, a6]) AS a FROM k WHERE event_type = 'click') WHERE a IS NOT NULL),
        f AS (SELECT a, min(user_id) AS user_id, count(*) AS n FROM o GROUP BY 1)
        SELECT k.message_id, least(f4.user_id, f6.user_id) AS user_id, coalesce(f4.n, 0) + coalesce(f6.n, 0) AS matches
        FROM k LEFT JOIN f f4 ON f4.a = k.a4 LEFT JOIN f f6 ON f6.a = k.a6""",
        "messages",
    ),
)
def _(spark, sf):
    """Whose address a message was sent from: IPv4 by equality, IPv6 by prefix, of the users seen in SIP."""
    messages = bound(spark, sf, "messages")
    addresses = ("ue_ipv4", "ue_ipv6")
    owners = messages.filter("event_type = 'click'").select("user_id", *addresses)
    found = M.address_owners(messages.select("message_id", *addresses), owners, addresses, "user_id")
    return found.select("message_id", "user_id", "matches")


@register(
    "same_pool_members",
    f"""WITH r AS (SELECT {_REGISTRY} FROM customer), p AS (SELECT {_PROBE} FROM supplier),
    a AS (SELECT mcc, mnc, mme_group_id, count(*) AS left_members FROM p WHERE mme_group_id IS NOT NULL GROUP BY ALL),
    b AS (SELECT mcc, mnc, mme_group_id, count(*) AS right_members FROM r WHERE mme_group_id IS NOT NULL GROUP BY ALL)
    SELECT * FROM a JOIN b USING (mcc, mnc, mme_group_id)""",
)
def _(spark, sf):
    registry = table(spark, sf, "customer").selectExpr(*_split(_REGISTRY))
    probes = table(spark, sf, "supplier").selectExpr(*_split(_PROBE))
    return M.same_pool(probes, registry)
