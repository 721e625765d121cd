"""Filter, classification and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, core, identifiers, phones
from ..operators import filters as FI
from ..sources import captures
from .bindings import bound, check, table
from .registry import register


@register(
    "rule_filter",
    check(
        """SELECT message_id, protocol, payload_length FROM messages
        WHERE protocol = 'SIP' OR payload_length >= 500 OR message_type = 'DIAMETER_CCR'""",
        "messages",
    ),
)
def _(spark, sf):
    rules = ['packet.protocol == "SIP"', "packet.length >= 500", "kind == DIAMETER_CCR", "nothing.here > 3", "packet.protocol > 5"]
    fields = {"packet.protocol": "protocol", "packet.length": "payload_length", "kind": F.col("message_type")}
    return FI.rule_filter(bound(spark, sf, "messages"), rules, fields).select("message_id", "protocol", "payload_length")


@register(
    "session_filter",
    check(
        """SELECT * FROM call_sessions WHERE session_type = '1-URGENT' AND start_ts >= epoch_us(TIMESTAMP '1996-01-01 00:00:00')
        AND start_ts <= epoch_us(TIMESTAMP '1997-12-31 00:00:00')""",
        "call_sessions",
    ),
)
def _(spark, sf):
    return FI.matching(
        bound(spark, sf, "call_sessions"), session_type="1-URGENT", job_id=None,
        start_ts=(F.expr("TIMESTAMP '1996-01-01 00:00:00'"), F.expr("TIMESTAMP '1997-12-31 00:00:00'")),
    )


@register(
    "sessions_with_protocol",
    check(
        "SELECT * FROM call_sessions WHERE session_id IN (SELECT session_id FROM leg_messages WHERE protocol = 'F' AND bytes > 45)",
        "call_sessions", "leg_messages",
    ),
)
def _(spark, sf):
    wanted = (F.col("protocol") == "F") & (F.col("bytes") > 45)
    return FI.having_child(bound(spark, sf, "call_sessions"), bound(spark, sf, "leg_messages"), "session_id", wanted)


@register(
    "subscriber_filter",
    check("SELECT message_id, imsi, msisdn FROM messages WHERE imsi = '310260000000007' OR msisdn = '14150000002'", "messages"),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages")
    hit = FI.rule_filter(messages, ['imsi == "310260000000007"', 'msisdn == "14150000002"'])
    return hit.select("message_id", "imsi", "msisdn")


@register(
    "party_filter",
    check("SELECT packet_id, src_ip, dst_ip, bytes, l_suppkey FROM packets WHERE src_ip = 'S7' OR dst_ip = 'S7' OR dst_ip = 'C7'", "packets"),
)
def _(spark, sf):
    packets = bound(spark, sf, "packets")
    either = FI.any_column(packets, ["src_ip", "dst_ip"], "S7").unionByName(
        FI.any_column(packets, ["dst_ip"], "C7").filter("src_ip <> 'S7'")
    )
    return either.select("packet_id", "src_ip", "dst_ip", "bytes", "l_suppkey")


@register(
    "message_type_codes",
    check(
        """SELECT protocol, message_type, count(*) AS n FROM (
          SELECT 'SIP' AS protocol, CASE WHEN is_request THEN CASE method WHEN 'INVITE' THEN 'SIP_INVITE' WHEN 'ACK' THEN 'SIP_ACK'
            WHEN 'BYE' THEN 'SIP_BYE' WHEN 'CANCEL' THEN 'SIP_CANCEL' WHEN 'REGISTER' THEN 'SIP_REGISTER' ELSE 'UNKNOWN' END
            ELSE CASE status_code WHEN 100 THEN 'SIP_TRYING' WHEN 180 THEN 'SIP_RINGING' WHEN 200 THEN 'SIP_OK' ELSE 'UNKNOWN' END END
            AS message_type FROM sip
          UNION ALL SELECT 'DIAMETER', CASE WHEN command_code = 272 THEN CASE WHEN is_request THEN 'DIAMETER_CCR' ELSE 'DIAMETER_CCA' END
            ELSE CASE WHEN is_request THEN 'DIAMETER_AAR' ELSE 'DIAMETER_AAA' END END FROM diameter
          UNION ALL SELECT 'GTP_C', CASE message_type WHEN 32 THEN 'GTP_CREATE_SESSION_REQ' WHEN 33 THEN 'GTP_CREATE_SESSION_RESP'
            WHEN 36 THEN 'GTP_DELETE_SESSION_REQ' WHEN 37 THEN 'GTP_DELETE_SESSION_RESP' ELSE 'UNKNOWN' END FROM gtp)
        GROUP BY ALL""",
        "sip", "diameter", "gtp",
    ),
)
def _(spark, sf):
    none, text = F.lit(None), F.lit(None).cast("string")
    rows = (
        bound(spark, sf, "sip").select(F.lit("SIP").alias("protocol"), "is_request", "method", F.col("status_code").alias("code"))
        .union(bound(spark, sf, "diameter").select(F.lit("DIAMETER"), "is_request", text, "command_code"))
        .union(bound(spark, sf, "gtp").select(F.lit("GTP_C"), none.cast("boolean"), text, "message_type"))
    )
    kind = codes.message_type("protocol", "is_request", "method", "code")
    return rows.groupBy("protocol", kind.alias("message_type")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "interface_of_ports",
    check(
        """SELECT packet_id, l_partkey, l_suppkey, CASE
          WHEN transport = 'SCTP' AND 36412 IN (src_port, dst_port) THEN 'S1-MME' WHEN transport = 'SCTP' AND 38412 IN (src_port, dst_port) THEN 'N2'
          WHEN transport = 'SCTP' AND 36422 IN (src_port, dst_port) THEN 'X2' WHEN transport = 'SCTP' AND 3868 IN (src_port, dst_port) THEN 'Diameter'
          WHEN transport = 'UDP' AND 2123 IN (src_port, dst_port) THEN 'S11' WHEN transport = 'UDP' AND 2152 IN (src_port, dst_port) THEN 'S1-U'
          WHEN transport = 'UDP' AND 8805 IN (src_port, dst_port) THEN 'N4' WHEN transport = 'UDP' AND 5060 IN (src_port, dst_port) THEN 'IMS-SIP'
          WHEN transport = 'UDP' AND (src_port BETWEEN 10000 AND 64999 OR dst_port BETWEEN 10000 AND 64999) THEN 'IMS-RTP'
          WHEN transport = 'TCP' AND 3868 IN (src_port, dst_port) THEN 'Diameter' WHEN transport = 'TCP' AND 5060 IN (src_port, dst_port) THEN 'IMS-SIP'
          WHEN transport = 'TCP' AND (80 IN (src_port, dst_port) OR 443 IN (src_port, dst_port)) THEN 'HTTP-API' ELSE 'Unknown' END AS interface,
          CASE WHEN src_port < 10000 AND dst_port > 10000 THEN 'SERVER_TO_CLIENT' WHEN dst_port < 10000 AND src_port > 10000
            THEN 'CLIENT_TO_SERVER' ELSE 'UNKNOWN' END AS direction FROM packets""",
        "packets",
    ),
)
def _(spark, sf):
    return bound(spark, sf, "packets").select(
        "packet_id", "l_partkey", "l_suppkey",
        codes.interface_of_ports("transport", "src_port", "dst_port").alias("interface"),
        codes.direction_of_ports("src_port", "dst_port").alias("direction"),
    )


@register(
    "network_functions",
    """SELECT service, CASE WHEN service LIKE 'namf%' THEN 'AMF' WHEN service LIKE 'nudm%' THEN 'UDM' ELSE 'Unknown-NF' END AS network_function,
      count(*) AS n FROM (SELECT split_part(p, '/', 2) AS service FROM (
        SELECT CASE page_id % 3 WHEN 0 THEN '/namf-comm/v1' WHEN 1 THEN '/nudm-ueau/v1' ELSE regexp_extract(url, '//[^/]+(/[^?#]*)', 1) END AS p FROM pages))
    GROUP BY service""",
)
def _(spark, sf):
    path = F.expr(
        "CASE page_id % 3 WHEN 0 THEN '/namf-comm/v1' WHEN 1 THEN '/nudm-ueau/v1' ELSE regexp_extract(url, '//[^/]+(/[^?#]*)', 1) END"
    )
    rows = table(spark, sf, "pages").select(codes.service_of_path(path).alias("service"))
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n")).select(
        "service", codes.network_function("service").alias("network_function"), "n"
    )


@register(
    "capture_interface_types",
    check(
        """SELECT l_partkey % 7 AS capture, CASE WHEN bool_or(src_port = 36412 OR dst_port = 36412) THEN 'S1_MME'
          WHEN bool_or(38412 IN (src_port, dst_port)) THEN 'N2' WHEN bool_or(36422 IN (src_port, dst_port)) THEN 'X2_C'
          WHEN bool_or(2123 IN (src_port, dst_port)) THEN 'S5_S8_C' WHEN bool_or(2152 IN (src_port, dst_port)) THEN 'S1_U'
          WHEN bool_or(8805 IN (src_port, dst_port)) THEN 'N4'
          WHEN bool_or(3868 IN (src_port, dst_port)) AND bool_or(protocol = 'DIAMETER') THEN 'S6A'
          WHEN bool_or(src_port IN (5060, 5061) OR dst_port IN (5060, 5061)) THEN 'IMS_SIP'
          WHEN bool_or(src_port BETWEEN 10000 AND 20000 OR dst_port BETWEEN 10000 AND 20000) THEN 'RTP_MEDIA'
          WHEN bool_or(src_port IN (80, 443) OR dst_port IN (80, 443)) THEN 'SG_I' ELSE 'UNKNOWN' END AS interface_type
        FROM packets GROUP BY 1""",
        "packets",
    ),
)
def _(spark, sf):
    packets = bound(spark, sf, "packets").withColumn("capture", F.col("l_partkey") % 7)
    return captures.type_of_traffic(packets, "capture", ("src_port", "dst_port"), "protocol")


# Names as they stand on capture interfaces, every type at least once.
_CAPTURE_NAMES = [
    ("eth0-S1-MME", "S1_MME"), ("s1ap trunk", "S1_MME"), ("S1 towards MME", "S1_MME"), ("S1_U", "S1_U"), ("S1 user traffic", "S1_U"),
    ("s1-users", "S1_U"), ("s1user", "UNKNOWN"), ("X2AP", "X2_C"), ("x2c", "X2_C"), ("S5-C", "S5_S8_C"), ("s8 control", "S5_S8_C"),
    ("S8_UP", "S5_S8_U"), ("s5u", "S5_S8_U"), ("S6 to HSS", "S6A"), ("s6d", "S6A"), ("Gx", "GX"), ("PCRF and PCEF", "GX"),
    ("P-CSCF to PCRF", "RX"), ("online charging", "GY"), ("SGi", "SG_I"), ("internet", "SG_I"), ("AMF to gNB", "N2"), ("ngap", "N2"),
    ("gNB to UPF user", "N3"), ("SMF to UPF", "N4"), ("PFCP", "N4"), ("n6", "N6"), ("S-CSCF", "IMS_SIP"), ("sip trunk", "IMS_SIP"),
    ("RTP", "RTP_MEDIA"), ("video", "RTP_MEDIA"), ("uplink", "UNKNOWN"),
]


@register(
    "capture_interface_names",
    f"SELECT p_partkey, {[kind for _, kind in _CAPTURE_NAMES]}[p_partkey % {len(_CAPTURE_NAMES)} + 1] AS interface_type FROM part",
)
def _(spark, sf):
    """Each part stands for a capture interface with a name of its own."""
    names = F.array(*[F.lit(name) for name, _ in _CAPTURE_NAMES])
    name = F.element_at(names, (F.col("p_partkey") % len(_CAPTURE_NAMES) + 1).cast("int"))
    text = F.concat_ws(" ", name, F.concat(F.lit("if"), "p_partkey"))
    return table(spark, sf, "part").select("p_partkey", captures.type_of_name(text).alias("interface_type"))


@register(
    "pdn_and_result_classes",
    check(
        """SELECT pdn_class, result_class, count(*) AS n FROM (SELECT CASE WHEN apn = 'IMS.mnc260' THEN 'IMS' WHEN apn = 'internet' THEN 'INTERNET'
          WHEN apn = 'sos' THEN 'EMERGENCY' WHEN apn = 'mms.net' THEN 'MMS' ELSE 'OTHER' END AS pdn_class,
          CASE WHEN result_code BETWEEN 2000 AND 2999 THEN 'SUCCESS' WHEN result_code BETWEEN 3000 AND 3999 THEN 'PROTOCOL_ERROR'
            WHEN result_code BETWEEN 5000 AND 5999 THEN 'PERMANENT_FAILURE' ELSE 'UNKNOWN' END AS result_class
          FROM gtp JOIN diameter USING (frame_number)) GROUP BY ALL""",
        "gtp", "diameter",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "gtp").select("frame_number", "apn").join(
        bound(spark, sf, "diameter").select("frame_number", "result_code"), "frame_number"
    )
    return rows.groupBy(
        codes.pdn_class("apn").alias("pdn_class"), codes.result_class("result_code").alias("result_class")
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "establishment_view",
    check("SELECT frame_number, ts, teid, message_type, cause FROM gtp WHERE message_type IN (32, 33)", "gtp"),
)
def _(spark, sf):
    rows = bound(spark, sf, "gtp").filter(F.col("message_type").isin(32, 33))
    return rows.select("frame_number", "ts", "teid", "message_type", "cause").orderBy("ts", "frame_number")


@register(
    "short_descriptions",
    check(
        """SELECT frame_number, 'SIP' || CASE WHEN method = 'INVITE' THEN ' SIP_INVITE' ELSE '' END ||
          ' from ' || regexp_extract(from_uri, 'sip:([^@]*)@', 1) AS description FROM sip""",
        "sip",
    ),
)
def _(spark, sf):
    kind = F.when(F.col("method") == "INVITE", "SIP_INVITE").otherwise("UNKNOWN")
    return bound(spark, sf, "sip").select(
        "frame_number", codes.short_description(F.lit("SIP"), kind, "from_uri").alias("description")
    )


@register(
    "session_page",
    check("SELECT session_id, start_ts, volume FROM call_sessions ORDER BY volume DESC, session_id LIMIT 20 OFFSET 40", "call_sessions"),
)
def _(spark, sf):
    return FI.page(bound(spark, sf, "call_sessions"), "volume", "session_id", number=3).select("session_id", "start_ts", "volume")


@register(
    "deep_page",
    check("SELECT session_id, start_ts, volume FROM call_sessions ORDER BY start_ts DESC, session_id LIMIT 20 OFFSET 1200", "call_sessions"),
)
def _(spark, sf):
    """A page far down, found by counting ranges of the sort column."""
    rows = bound(spark, sf, "call_sessions")
    return FI.page(rows, "start_ts", "session_id", number=61, far_rows=1000).select("session_id", "start_ts", "volume")


@register(
    "filtered_page_with_total",
    check(
        """SELECT session_id, start_ts, (SELECT count(*) FROM call_sessions WHERE session_type = '5-LOW') AS total
        FROM call_sessions WHERE session_type = '5-LOW' ORDER BY start_ts DESC, session_id LIMIT 20""",
        "call_sessions",
    ),
)
def _(spark, sf):
    rows = FI.matching(bound(spark, sf, "call_sessions"), session_type="5-LOW")
    return FI.page_with_total(rows, "start_ts", "session_id").select("session_id", "start_ts", "total")


@register(
    "job_list",
    check("SELECT job_id, created_ts, status FROM jobs WHERE status = 'failed'", "jobs"),
)
def _(spark, sf):
    jobs = FI.matching(bound(spark, sf, "jobs"), status="failed")
    return jobs.select("job_id", "created_ts", "status").orderBy(F.col("created_ts").desc(), "job_id")


@register(
    "event_list_of_session",
    check("SELECT l_linenumber, l_partkey, ts, bytes FROM leg_messages WHERE session_id = 7", "leg_messages"),
)
def _(spark, sf):
    rows = FI.matching(bound(spark, sf, "leg_messages"), session_id=7)
    return rows.select("l_linenumber", "l_partkey", "ts", "bytes").orderBy("ts", "l_linenumber", "l_partkey")


_PHONE_TEXT = (
    "CASE c_custkey % 5 WHEN 0 THEN 'sip:+1415' || lpad(CAST(c_custkey AS STRING), 7, '0') || '@ims.example.com;user=phone' "
    "WHEN 1 THEN 'sip:415' || lpad(CAST(c_custkey AS STRING), 7, '0') || '@ims.example.com' "
    "WHEN 2 THEN 'tel:+90 (532) ' || lpad(CAST(c_custkey AS STRING), 7, '0') "
    "WHEN 3 THEN '0' || CAST(4155550000 + c_custkey AS STRING) ELSE 'msisdn-353' || lpad(CAST(c_custkey AS STRING), 9, '0') END"
)


@register(
    "phone_numbers",
    f"""WITH d AS (SELECT c_custkey, c_custkey % 5 AS form, regexp_replace(regexp_replace({_PHONE_TEXT}, '@.*$', ''), '[^0-9]', '', 'g') AS digits
        FROM customer),
      c AS (SELECT *, CASE form WHEN 0 THEN '1' WHEN 1 THEN '' WHEN 2 THEN '90' WHEN 3 THEN '' ELSE '353' END AS country FROM d)
    SELECT c_custkey, digits, country, regexp_replace(substr(digits, length(country) + 1), '^0+', '') AS national FROM c""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", phones.phone_number(F.expr(_PHONE_TEXT)).alias("p"))
    return rows.select("c_custkey", "p.digits", "p.country", "p.national")


@register(
    "subscriber_and_device_ids",
    """SELECT c_custkey, '310260' || lpad(CAST(c_custkey AS STRING), 9, '0') AS imsi, '310' AS mcc, '260' AS mnc,
      lpad(CAST(c_custkey AS STRING), 9, '0') AS msin, '35' || lpad(CAST(c_custkey * 7 AS STRING), 12, '0') AS imei,
      substr('35' || lpad(CAST(c_custkey * 7 AS STRING), 12, '0'), 1, 8) AS tac FROM customer""",
)
def _(spark, sf):
    number = F.expr("lpad(CAST(c_custkey AS STRING), 9, '0')")
    device = F.expr("'35' || lpad(CAST(c_custkey * 7 AS STRING), 12, '0')")
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        identifiers.imsi(F.concat(F.lit("imsi-310260"), number, F.lit("@ims.example.org"))).alias("s"),
        identifiers.imei(F.concat(F.lit("imei:"), device)).alias("d"),
    )
    return rows.select("c_custkey", F.col("s.digits").alias("imsi"), "s.mcc", "s.mnc", "s.msin", "d.imei", "d.tac")


@register(
    "formatted_times",
    check(
        "SELECT message_id, strftime(make_timestamp(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, ts // 1000 AS epoch_ms FROM messages",
        "messages",
    ),
)
def _(spark, sf):
    return bound(spark, sf, "messages").select(
        "message_id", core.iso_millis("ts").alias("iso"), core.epoch_millis("ts").alias("epoch_ms")
    )


@register(
    "uri_parts",
    check(
        """SELECT frame_number, regexp_extract(from_uri, 'sip:([^@]+)@', 1) AS user_part,
        regexp_extract(to_uri, 'sip:[^@]+@([^:;>]+)', 1) AS host_part FROM sip""",
        "sip",
    ),
)
def _(spark, sf):
    return bound(spark, sf, "sip").select(
        "frame_number", identifiers.uri_user("from_uri").alias("user_part"), identifiers.uri_host("to_uri").alias("host_part")
    )


@register(
    "expired_jobs_removed",
    check(
        """WITH gone AS (SELECT job_id FROM jobs WHERE created_ts < epoch_us(TIMESTAMP '1996-06-01 00:00:00'))
        SELECT 'jobs' AS kept, count(*) AS n FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone)
        UNION ALL SELECT 'sessions', count(*) FROM job_sessions WHERE job_id NOT IN (SELECT job_id FROM gone)
        UNION ALL SELECT 'events', count(*) FROM leg_messages WHERE session_id NOT IN (SELECT job_id FROM gone)""",
        "jobs", "job_sessions", "leg_messages",
    ),
)
def _(spark, sf):
    sessions = bound(spark, sf, "job_sessions").withColumn("session_id", F.col("job_id"))
    kept = FI.drop_older_jobs(
        bound(spark, sf, "jobs"), sessions, bound(spark, sf, "leg_messages"), "created_ts",
        F.expr("TIMESTAMP '1996-06-01 00:00:00'"),
    )
    parts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kept"), "n") for n, f in zip(("jobs", "sessions", "events"), kept)]
    return parts[0].union(parts[1]).union(parts[2])
