"""Bindings: the given tables read as the row shapes the operators take.

Each binding is one SELECT over whole tables, written once in the SQL that Spark and an ANSI engine share, so a
query and its check start from the same rows. Two spots differ by engine and are filled in by :func:`binding_sql`:
``TS(x)`` (a timestamp in Spark; epoch microseconds in the check, where every time is a BIGINT) and the table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_utc

_EVENTS = (
    "(SELECT event_id, ts, user_id, event_type, value, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events})"
)

BINDINGS: dict[str, str] = {
    # Signalling messages of many protocols with partly filled identifiers.
    "messages": f"""
SELECT event_id AS message_id, TS(ts) AS ts, user_id, event_type, k,
  20 + CAST(floor(value) AS BIGINT) AS payload_length,
  CASE event_type WHEN 'signup' THEN 'GTP_C' WHEN 'view' THEN 'DIAMETER' WHEN 'click' THEN 'SIP'
    WHEN 'purchase' THEN 'RTP' ELSE 'S1AP' END AS protocol,
  CASE event_type WHEN 'signup' THEN 'S11' WHEN 'view' THEN 'Diameter' WHEN 'click' THEN 'IMS-SIP'
    WHEN 'purchase' THEN 'IMS-RTP' ELSE 'S1-MME' END AS interface,
  CASE event_type
    WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'GTP_CREATE_SESSION_REQ' WHEN 1 THEN 'GTP_CREATE_SESSION_RESP'
      WHEN 2 THEN 'GTP_MODIFY_BEARER_REQ' ELSE 'GTP_MODIFY_BEARER_RESP' END
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'DIAMETER_CCR' WHEN 1 THEN 'DIAMETER_CCA' WHEN 2 THEN 'DIAMETER_AAR'
      ELSE 'DIAMETER_AAA' END
    WHEN 'click' THEN CASE k % 6 WHEN 0 THEN 'SIP_INVITE' WHEN 1 THEN 'SIP_TRYING' WHEN 2 THEN 'SIP_RINGING'
      WHEN 3 THEN 'SIP_OK' WHEN 4 THEN 'SIP_REGISTER' ELSE 'SIP_BYE' END
    WHEN 'purchase' THEN 'RTP'
    ELSE CASE k % 3 WHEN 0 THEN 'S1AP_INITIAL_UE_MESSAGE' WHEN 1 THEN 'S1AP_DOWNLINK_NAS_TRANSPORT'
      ELSE 'S1AP_UE_CONTEXT_RELEASE' END END AS message_type,
  CASE WHEN event_type IN ('signup', 'error') OR (event_type = 'click' AND k < 10)
    THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') END AS imsi,
  CASE WHEN event_type = 'view' OR (event_type = 'signup' AND k < 20)
    THEN '1415' || lpad(CAST(CAST(floor(user_id / 3) AS BIGINT) AS STRING), 7, '0') END AS msisdn,
  CASE WHEN event_type IN ('signup', 'click') AND k % 2 = 0
    THEN '10.0.' || CAST(user_id % 250 AS STRING) || '.' || CAST(k % 8 AS STRING) END AS ue_ipv4,
  CASE WHEN event_type = 'click' AND k % 3 = 0
    THEN '2001:db8:' || CAST(user_id AS STRING) || ':' || CAST(k % 4 AS STRING) || ':0:0:0:1' END AS ue_ipv6,
  CASE WHEN event_type = 'signup' THEN user_id * 100 + k % 5 END AS teid,
  CASE WHEN event_type = 'click' THEN 'icid-' || CAST(user_id AS STRING) || '-' || CAST(k % 10 AS STRING) END AS icid,
  '10.0.' || CAST(user_id % 250 AS STRING) || '.' || CAST(k % 8 AS STRING) AS src_ip,
  CASE event_type WHEN 'signup' THEN 2123 WHEN 'view' THEN 3868 WHEN 'click' THEN 5060
    WHEN 'purchase' THEN 20000 + k ELSE 36412 END AS src_port,
  '192.168.' || CAST(k % 20 AS STRING) || '.1' AS dst_ip,
  CASE WHEN k % 7 = 0 THEN 40000 + k ELSE 5060 END AS dst_port,
  CASE event_type WHEN 'purchase' THEN 'UDP' WHEN 'signup' THEN 'UDP' WHEN 'click' THEN 'UDP' WHEN 'view' THEN 'TCP'
    ELSE 'SCTP' END AS transport,
  CASE k % 5 WHEN 0 THEN 16777251 WHEN 1 THEN 16777238 WHEN 2 THEN 16777236 WHEN 3 THEN 16777217 ELSE 4 END
    AS application_id
FROM {_EVENTS}""",
    # SIP dialogue rows.
    "sip": f"""
SELECT event_id AS frame_number, TS(ts) AS ts, user_id, k,
  'c' || CAST(user_id AS STRING) || '-' || CAST(CAST(floor(k / 20) AS BIGINT) AS STRING) AS call_id,
  event_type IN ('signup', 'purchase', 'error') AS is_request,
  CASE event_type WHEN 'signup' THEN CASE WHEN k % 9 = 0 THEN 'REGISTER' WHEN k % 11 = 0 THEN 'MESSAGE' ELSE 'INVITE' END
    WHEN 'purchase' THEN 'ACK' WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 'CANCEL' ELSE 'BYE' END END AS method,
  CASE event_type WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 100 WHEN 1 THEN 180 ELSE 183 END
    WHEN 'click' THEN CASE WHEN k % 6 = 0 THEN 486 ELSE 200 END END AS status_code,
  CASE WHEN k % 8 = 0 THEN 'BYE' ELSE 'INVITE' END AS cseq_method,
  'sip:+1415' || lpad(CAST(user_id AS STRING), 7, '0') || '@ims.example.com;user=phone' AS from_uri,
  CASE WHEN k % 10 = 4 THEN 'urn:service:sos'
    ELSE 'sip:+1212' || lpad(CAST(k AS STRING), 7, '0') || '@ims.example.org' END AS to_uri,
  CASE WHEN k % 10 = 4 THEN 'urn:service:sos' ELSE 'sip:' || CAST(k AS STRING) || '@pcscf.example.net' END AS request_uri,
  'f' || CAST(user_id % 2 AS STRING) AS from_tag,
  CASE WHEN event_type IN ('view', 'click') THEN 't' || CAST(k % 2 AS STRING) ELSE '' END AS to_tag,
  'z9hG4bK' || CAST(user_id AS STRING) || '-' || CAST(k % 10 AS STRING) AS via_branch,
  1 + k % 4 AS via_count,
  CASE WHEN k % 5 <> 0 THEN '10.0.' || CAST(user_id % 250 AS STRING) || '.' || CAST(k % 3 AS STRING) END AS contact_ip,
  k % 2 AS expires, k % 10 <> 1 AS has_audio, k % 7 = 0 AS has_video,
  CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'RTP' ELSE 'SIP' END AS protocol,
  CASE WHEN event_type = 'signup' AND k % 13 = 5 THEN 'sip:+1646' || lpad(CAST(user_id % 90 AS STRING), 7, '0') || '@ims.example.com' END
    AS forward_uri
FROM {_EVENTS}""",
    "diameter": f"""
SELECT event_id AS frame_number, TS(ts) AS ts, user_id, k,
  CASE WHEN k % 6 = 0 THEN '' ELSE 'd' || CAST(user_id AS STRING) || '-' || CAST(k % 3 AS STRING) END AS session_id,
  event_type IN ('signup', 'view') AS is_request,
  CASE WHEN k % 2 = 0 THEN 272 ELSE 265 END AS command_code,
  user_id * 10 + k % 4 AS hop_by_hop_id,
  CASE WHEN event_type IN ('signup', 'view') THEN NULL WHEN k % 9 = 0 THEN 5030 WHEN k % 7 = 0 THEN 3004 ELSE 2001 END
    AS result_code,
  CASE k % 4 WHEN 0 THEN 'Gx' WHEN 1 THEN 'Rx' WHEN 2 THEN 'Cx' ELSE 'Sh' END AS interface,
  CASE WHEN k % 3 <> 0 THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') END AS imsi,
  CASE WHEN k % 3 = 0 THEN '1415' || lpad(CAST(user_id AS STRING), 7, '0') END AS msisdn,
  '10.0.' || CAST(user_id % 250 AS STRING) || '.' || CAST(k % 3 AS STRING) AS framed_ip
FROM {_EVENTS}""",
    "gtp": f"""
SELECT event_id AS frame_number, TS(ts) AS ts, user_id AS teid, k AS sequence,
  CASE event_type WHEN 'signup' THEN 32 WHEN 'view' THEN 33 WHEN 'click' THEN 35 WHEN 'purchase' THEN 36 ELSE 37 END
    AS message_type,
  CASE WHEN event_type IN ('signup', 'purchase') THEN NULL WHEN k % 8 = 0 THEN 64 ELSE 16 END AS cause,
  CASE WHEN k % 2 = 0 THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') END AS imsi,
  CASE WHEN k % 5 = 0 THEN '1415' || lpad(CAST(user_id AS STRING), 7, '0') END AS msisdn,
  CASE k % 5 WHEN 0 THEN 'IMS.mnc260' WHEN 1 THEN 'internet' WHEN 2 THEN 'sos' WHEN 3 THEN 'mms.net' ELSE 'corp' END AS apn,
  5 + k % 3 AS ebi, 1 + k % 9 AS qci, k % 3 = 0 AS is_default,
  '10.0.' || CAST(user_id % 250 AS STRING) || '.1' AS ip, 20 + CAST(floor(value) AS BIGINT) AS bytes
FROM {_EVENTS}""",
    # S1AP rows; one radio id per user.
    "s1ap": f"""
SELECT event_id AS frame_number, TS(ts) AS ts, user_id AS enb_ue_id,
  CASE WHEN event_type <> 'signup' THEN user_id * 1000 + k END AS mme_ue_id,
  CASE event_type WHEN 'signup' THEN 'INITIAL_UE_MESSAGE' WHEN 'view' THEN 'INITIAL_CONTEXT_SETUP_REQUEST'
    WHEN 'click' THEN 'INITIAL_CONTEXT_SETUP_RESPONSE' WHEN 'purchase' THEN 'PATH_SWITCH_REQUEST'
    ELSE CASE WHEN k % 2 = 0 THEN 'UE_CONTEXT_RELEASE_COMMAND' ELSE 'UE_CONTEXT_RELEASE_COMPLETE' END END AS message_type
FROM {_EVENTS}""",
    "nas": f"""
SELECT event_id AS message_id, TS(ts) AS ts,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'ESM' ELSE 'EMM' END AS kind,
  CASE event_type WHEN 'signup' THEN 'ATTACH_REQUEST' WHEN 'view' THEN 'ATTACH_ACCEPT' WHEN 'error' THEN
    CASE WHEN k % 2 = 0 THEN 'TAU_REQUEST' ELSE 'DETACH_REQUEST' END ELSE 'PDN_CONNECTIVITY_REQUEST' END AS message_type,
  CASE WHEN k % 4 = 0 THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') END AS imsi,
  CASE WHEN k % 4 = 1 THEN user_id * 7 END AS tmsi,
  CASE WHEN k % 2 = 0 THEN CAST(user_id AS STRING) || '/' || CAST(user_id % 5 AS STRING) END AS context_pair,
  CASE WHEN k % 3 = 0 THEN 'IMS' ELSE 'internet' END AS apn
FROM {_EVENTS}""",
    # Media packets: one stream per user, sequence numbers that wrap.
    "rtp": f"""
SELECT event_id AS frame_number, TS(ts) AS ts, user_id AS ssrc, (event_id * 7) % 65536 AS sequence_number,
  event_id * 160 + k AS rtp_timestamp,
  CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 18 WHEN 3 THEN 96 WHEN 4 THEN 97 ELSE 99 END AS payload_type,
  '10.0.' || CAST(user_id % 250 AS STRING) || '.' || CAST(k % 3 AS STRING) AS src_ip,
  '10.9.' || CAST(k % 50 AS STRING) || '.1' AS dst_ip
FROM {_EVENTS}""",
    # Echo requests and responses of one tunnel per user.
    "echoes": f"""
SELECT event_id AS frame_number, TS(ts) AS ts, user_id AS teid,
  CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN 'REQ' ELSE 'RESP' END AS kind
FROM {_EVENTS}""",
    # Identity observations.
    "identities": f"""
SELECT event_id AS obs_id, TS(ts) AS ts, user_id,
  CASE WHEN event_type IN ('signup', 'view') THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') END AS imsi,
  CASE WHEN event_type = 'view' OR k % 5 = 0 THEN '1415' || lpad(CAST(CAST(floor(user_id / 2) AS BIGINT) AS STRING), 7, '0')
    END AS msisdn,
  CASE WHEN event_type = 'click' THEN '35' || lpad(CAST(user_id * 1000 + k % 2 AS STRING), 12, '0') END AS imei,
  CASE WHEN event_type IN ('purchase', 'signup') THEN user_id * 10 + k % 2 END AS tmsi,
  CASE WHEN event_type IN ('click', 'error') OR k % 10 = 0 THEN '10.1.' || CAST(user_id AS STRING) || '.' || CAST(k % 2 AS STRING) END AS ipv4
FROM {_EVENTS}""",
    # Identity observations with temporary identifiers; the addresses 10.8.x.y are handed on between users.
    "observations": f"""
SELECT event_id AS obs_id, TS(ts) AS ts, user_id, k, event_type AS source,
  CASE WHEN event_type IN ('signup', 'view') THEN '310260' || lpad(CAST(user_id AS STRING), 9, '0') END AS imsi,
  CASE WHEN event_type = 'view' OR k % 5 = 0 THEN '1415' || lpad(CAST(user_id AS STRING), 7, '0') END AS msisdn,
  CASE WHEN event_type = 'click' THEN '35' || lpad(CAST(user_id * 1000 + k % 2 AS STRING), 12, '0') END AS imei,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN '310260-32769-1-' || CAST(user_id * 10 + k % 2 AS STRING) END AS guti,
  CASE WHEN event_type IN ('purchase', 'click') AND k % 4 < 2 THEN user_id * 10 + k % 2 END AS tmsi,
  CASE WHEN event_type IN ('signup', 'view') AND k % 3 = 0 THEN '10.8.' || CAST((user_id * 7 + k) % 32 AS STRING) || '.1'
    WHEN event_type = 'error' AND k % 25 = 7 THEN '10.8.' || CAST(k % 32 AS STRING) || '.1'
    WHEN event_type = 'purchase' AND k % 7 = 0 THEN '10.1.' || CAST(user_id AS STRING) || '.' || CAST(k % 2 AS STRING) END AS ipv4,
  CASE WHEN k % 6 = 1 THEN '2001:db8:' || CAST(user_id AS STRING) || ':' || CAST(k % 4 AS STRING) || ':0:0:0:' || CAST(k AS STRING) END AS ipv6,
  CASE WHEN event_type IN ('purchase', 'error') AND k % 4 = 1 THEN '192.168.1.1/' || CAST(user_id * 100 + k % 3 AS STRING) END AS tunnel,
  CASE WHEN event_type = 'error' AND k % 4 = 1 THEN 1 + k % 15 END AS pdu_session,
  CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN CAST(user_id * 1000 + k AS STRING) || '/' || CAST(user_id AS STRING) END AS ue_ids,
  CASE WHEN event_type = 'click' THEN 'c' || CAST(user_id AS STRING) || '-' || CAST(CAST(floor(k / 20) AS BIGINT) AS STRING) END AS call_id,
  CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'icid-' || CAST(user_id AS STRING) || '-' || CAST(k % 10 AS STRING) END AS icid
FROM {_EVENTS}""",
    # Packets between supplier and customer addresses.
    "packets": """
SELECT l_orderkey AS session_id, TS(l_shipdate) AS ts, l_orderkey * 10 + l_linenumber AS packet_id,
  'S' || CAST(l_suppkey AS STRING) AS src_ip, 'C' || CAST(o_custkey AS STRING) AS dst_ip,
  CAST(CASE l_linenumber % 8 WHEN 0 THEN 2123 WHEN 1 THEN 2152 WHEN 2 THEN 5060 WHEN 3 THEN 3868 WHEN 4 THEN 36412
    WHEN 5 THEN 8805 WHEN 6 THEN 443 ELSE 12000 END AS BIGINT) AS src_port,
  CAST(1024 + l_partkey % 60000 AS BIGINT) AS dst_port,
  CASE l_linenumber % 4 WHEN 0 THEN 'SCTP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'TCP' ELSE 'UDP' END AS transport,
  CASE l_returnflag WHEN 'A' THEN 'SIP' WHEN 'N' THEN 'DIAMETER' ELSE 'UNKNOWN' END AS protocol,
  CAST(l_quantity AS BIGINT) AS bytes, l_linestatus AS interface_id, l_partkey, l_suppkey, l_linenumber, o_custkey AS job_id,
  l_returnflag AS leg
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Jobs and their sessions.
    "jobs": """
SELECT o_orderkey AS job_id, TS(o_orderdate) AS created_ts, o_totalprice AS size_bytes,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
    WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status
FROM {orders}""",
    "job_sessions": """
SELECT l_orderkey AS job_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS packets,
  CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_partkey AS duration_ms,
  CASE l_returnflag WHEN 'A' THEN 'SIP' WHEN 'N' THEN 'DIAMETER' ELSE 'GTP' END AS protocol
FROM {lineitem}""",
    "call_sessions": """
SELECT o_orderkey AS session_id, o_custkey AS job_id, o_orderpriority AS session_type, TS(o_orderdate) AS start_ts,
  o_totalprice AS volume, o_orderstatus AS state
FROM {orders}""",
    "leg_messages": """
SELECT l_orderkey AS session_id, TS(l_shipdate) AS ts, l_linenumber, l_partkey, l_suppkey, l_returnflag AS interface,
  l_linestatus AS protocol, CAST(l_quantity AS BIGINT) AS bytes
FROM {lineitem}""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-free times become UTC timestamps."""
    frame = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    times = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else frame


#: Bindings that join two tables: each table with the column it is joined by.
JOINED_BY = {"packets": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
#: Most rows of the larger table of a join that one task should sort, and then group by the join's key.
ROWS_PER_TASK = 1_000_000


def dealt(tables: dict[str, DataFrame], by: dict[str, str]) -> dict[str, DataFrame]:
    """``tables`` dealt by the columns they are joined by, so that a task's rows stay at :data:`ROWS_PER_TASK` as the tables grow.

    Left to itself, Spark gives each core one share of a narrow join (it packs shuffle output by its compressed size), and what
    a task sorts and groups grows with the input. Tables that come to fewer rows for each core are left as they are.
    """
    rows = max(tables[t].count() for t in by)
    tasks = -(-rows // ROWS_PER_TASK)
    if tasks <= next(iter(tables.values())).sparkSession.sparkContext.defaultParallelism:
        return tables
    return {t: frame.repartition(tasks, by[t]) if t in by else frame for t, frame in tables.items()}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    text = re.sub(r"\bTS\((\w+)\)", r"\1", BINDINGS[name])
    used = {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **(dealt(used, JOINED_BY[name]) if name in JOINED_BY else used))


def binding_sql(name: str) -> str:
    """The same binding for the check engine."""
    text = re.sub(r"\bTS\((\w+)\)", r"epoch_us(\1)", BINDINGS[name])
    return re.sub(r"\{(\w+)\}", r"\1", text)


def check(body: str, *bindings: str, recursive: bool = False) -> str:
    """Check SQL: the bindings as common table expressions in front of ``body`` (which may add its own)."""
    ctes = ", ".join(f"{b} AS ({binding_sql(b)})" for b in bindings)
    body = body.strip()
    lead = "WITH RECURSIVE " if recursive else "WITH "
    if body[:5].upper() == "WITH ":
        return f"{lead}{ctes}, {body[5:]}" if ctes else f"{lead}{body[5:]}"
    return f"{lead}{ctes} {body}" if ctes else body


def plain(df: DataFrame) -> DataFrame:
    """Result with times as epoch microseconds, the form the check produces."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.unix_micros(c) for c in times}) if times else df
