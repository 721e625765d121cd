"""Session, subscriber, tunnel and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators import tunnels as T
from ..operators.components import bounded_in_time, key_nodes, key_rows, merge_by_keys, nodes_of, without_listed
from .bindings import bound, check
from .registry import register

# Reachability over shared identifiers, written as a recursive walk to the smallest message.
_MERGED = """WITH kv AS (SELECT message_id, unnest(['imsi:' || imsi, 'msisdn:' || msisdn, 'ue_ip:' || ue_ipv4, 'ue_ip:' || ue_ipv6, 'teid:' || teid,
    'icid:' || icid]) AS node FROM messages),
  kn AS (SELECT * FROM kv WHERE node IS NOT NULL),
  anchor AS (SELECT message_id, min(node) AS a FROM kn GROUP BY 1),
  e1 AS (SELECT DISTINCT a.a, k.node AS b FROM anchor a JOIN kn k USING (message_id) WHERE a.a <> k.node),
  e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
  nodes AS (SELECT DISTINCT node FROM kn),
  walk(node, seen) AS (SELECT node, node FROM nodes UNION SELECT w.node, e.b FROM walk w JOIN e ON w.seen = e.a),
  root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1),
  mr AS (SELECT a.message_id, r.root FROM anchor a JOIN root r ON a.a = r.node),
  ids AS (SELECT root, min(message_id) AS session_id FROM mr GROUP BY 1),
  merged AS (SELECT mr.message_id, ids.session_id FROM mr JOIN ids USING (root)),
  ms AS (SELECT m.*, g.session_id FROM messages m JOIN merged g USING (message_id))"""

def _keys():
    columns = {"imsi": "imsi", "msisdn": "msisdn", "ue_ip/v4": "ue_ipv4", "ue_ip/v6": "ue_ipv6", "teid": "teid", "icid": "icid"}
    return {name: F.col(c) for name, c in columns.items()}


def merged_messages(spark, sf):
    """Messages with their session."""
    return merge_by_keys(bound(spark, sf, "messages").withColumn("nodes", key_nodes(_keys())), "nodes", "message_id")


@register("key_merge_sessions", check(_MERGED + " SELECT * FROM merged", "messages", recursive=True))
def _(spark, sf):
    return merged_messages(spark, sf).select("message_id", "session_id")


_ROLLED = _MERGED + """, rolled AS (SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, (max(ts) - min(ts)) // 1000 AS duration_ms, count(*) AS packets,
    CAST(sum(payload_length) AS BIGINT) AS bytes, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols,
    count(DISTINCT interface) AS legs, string_agg(DISTINCT interface, ',' ORDER BY interface) AS interfaces,
    min_by(imsi, (ts, message_id)) FILTER (imsi IS NOT NULL) AS imsi, min_by(msisdn, (ts, message_id)) FILTER (msisdn IS NOT NULL) AS msisdn,
    CASE WHEN bool_or(interface = 'IMS-SIP') AND bool_or(interface = 'IMS-RTP') THEN 'VoLTE-Call'
      WHEN bool_or(interface = 'S1-MME') AND bool_or(interface = 'S11') AND count(DISTINCT interface) >= 3 THEN 'LTE-Attach'
      WHEN bool_or(interface = 'S1-MME') AND bool_or(interface = 'S11') THEN 'LTE-PDN-Connect'
      WHEN count(DISTINCT interface) > 1 THEN 'Mixed' ELSE 'Incomplete' END AS session_type, max(ts) > min(ts) AS is_complete
  FROM ms GROUP BY session_id)"""


def _rolled(spark, sf):
    return S.session_rollup(merged_messages(spark, sf), "session_id", ["ts", "message_id"], "payload_length", ["imsi", "msisdn"])


@register("session_rollup", check(_ROLLED + " SELECT * FROM rolled", "messages", recursive=True))
def _(spark, sf):
    return _rolled(spark, sf).withColumn("legs", F.col("legs").cast("bigint"))


@register(
    "leg_rollup",
    check(
        """SELECT session_id, interface, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes
        FROM leg_messages GROUP BY session_id, interface""",
        "leg_messages",
    ),
)
def _(spark, sf):
    return S.leg_rollup(bound(spark, sf, "leg_messages"), "session_id", "interface", "ts", "bytes")


@register(
    "session_participants",
    check(
        """SELECT DISTINCT session_id, src_ip || ':' || src_port AS participant FROM packets
        UNION SELECT session_id, dst_ip || ':' || dst_port FROM packets""",
        "packets",
    ),
)
def _(spark, sf):
    return S.participants(bound(spark, sf, "packets"), "session_id", [("src_ip", "src_port"), ("dst_ip", "dst_port")])


@register(
    "session_markers",
    check(
        "SELECT user_id, bool_or(message_type = 'SIP_INVITE') AS has_start, bool_or(message_type = 'SIP_BYE') AS has_end FROM messages GROUP BY 1",
        "messages",
    ),
)
def _(spark, sf):
    return S.session_markers(bound(spark, sf, "messages"), "user_id", "message_type")


@register(
    "session_setup_times",
    check(
        """WITH b AS (SELECT user_id, min(ts) AS t FROM messages WHERE message_type = 'SIP_INVITE' GROUP BY 1)
        SELECT user_id, (min(ts) - min(t)) // 1000 AS setup_time_ms FROM messages JOIN b USING (user_id) WHERE message_type = 'SIP_OK' AND ts >= t GROUP BY 1""",
        "messages",
    ),
)
def _(spark, sf):
    kind = F.col("message_type")
    return S.setup_time(bound(spark, sf, "messages"), "user_id", "ts", kind == "SIP_INVITE", kind == "SIP_OK")


@register(
    "correlation_statistics",
    check(
        _ROLLED + """ SELECT count(*) AS total_sessions, CAST(sum(packets) AS BIGINT) AS total_messages, CAST(sum(bytes) AS BIGINT) AS total_bytes,
        round(avg(duration_ms), 6) AS avg_duration_ms FROM rolled""",
        "messages", recursive=True,
    ),
)
def _(spark, sf):
    found = S.correlation_statistics(_rolled(spark, sf)).drop("avg_setup_time_ms")
    return found.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@register(
    "messages_by_interface_map",
    check(
        """SELECT string_agg(interface || '=' || n, ',' ORDER BY interface) AS messages_by_interface
        FROM (SELECT interface, count(*) AS n FROM messages GROUP BY 1)""",
        "messages",
    ),
)
def _(spark, sf):
    counted = S.count_map(bound(spark, sf, "messages"), "interface", "m")
    entries = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counted.select(F.array_join(F.array_sort(entries), ",").alias("messages_by_interface"))


_OWNED = """WITH claims AS (SELECT ts, message_id, imsi, ue_ipv4 AS ip FROM messages WHERE message_type = 'GTP_CREATE_SESSION_REQ' AND imsi IS NOT NULL AND ue_ipv4 IS NOT NULL),
        pr AS (SELECT ts, message_id, unnest([1, 2, 3, 4]) AS rank, unnest([ue_ipv4, ue_ipv6, src_ip, dst_ip]) AS ip FROM messages WHERE protocol = 'SIP' AND imsi IS NULL),
        hits AS (SELECT p.message_id, p.rank, (SELECT max_by(c.imsi, (c.ts, c.message_id)) FROM claims c WHERE c.ip = p.ip AND c.ts <= p.ts) AS imsi FROM pr p WHERE p.ip IS NOT NULL),
        f AS (SELECT message_id, min_by(imsi, rank) AS found FROM hits WHERE imsi IS NOT NULL GROUP BY 1),
        o AS (SELECT m.* EXCLUDE (imsi), coalesce(m.imsi, f.found) AS imsi FROM messages m LEFT JOIN f USING (message_id)
          WHERE protocol IN ('SIP', 'DIAMETER') OR (message_type = 'GTP_CREATE_SESSION_REQ' AND m.imsi IS NOT NULL))"""


@register(
    "master_sessions",
    check(
        _OWNED
        + """
        SELECT imsi, min(ts) AS start_ts, max(ts) AS last_update_ts, max_by(user_id, (ts, message_id)) FILTER (protocol = 'GTP_C') AS gtp_session,
          count(DISTINCT CASE WHEN protocol = 'SIP' THEN user_id END) AS sip_sessions, count(DISTINCT CASE WHEN protocol = 'DIAMETER' THEN user_id END) AS diameter_sessions,
          max_by(msisdn, (ts, message_id)) FILTER (msisdn IS NOT NULL) AS msisdn, count(*) AS events FROM o WHERE imsi IS NOT NULL GROUP BY imsi""",
        "messages",
    ),
)
def _(spark, sf):
    return S.master_sessions(bound(spark, sf, "messages"), "user_id", "message_id", ["ts", "message_id"])


@register("master_session_links", check(_OWNED + " SELECT DISTINCT imsi, protocol, user_id FROM o WHERE imsi IS NOT NULL", "messages"))
def _(spark, sf):
    owned = S.subscriber_messages(bound(spark, sf, "messages"), "message_id", ["ts", "message_id"])
    return S.master_session_links(owned, "imsi", "user_id", "protocol")


_IDENTIFIERS = ("imsi", "msisdn", "ue_ipv4", "ue_ipv6")


@register(
    "session_primary_identifiers",
    check(
        """WITH r AS (SELECT user_id * 100 + k AS session_id, """
        + ", ".join(f"min_by({c}, (ts, message_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in _IDENTIFIERS)
        + " FROM messages GROUP BY 1) SELECT session_id, coalesce(imsi, msisdn, ue_ipv4, ue_ipv6, 'unknown') AS primary_identifier FROM r",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").withColumn("session_id", F.expr("user_id * 100 + k"))
    rolled = S.session_rollup(messages, "session_id", ["ts", "message_id"], "payload_length", _IDENTIFIERS)
    return rolled.select("session_id", S.primary_identifier(_IDENTIFIERS).alias("primary_identifier"))


def _listed(keyed):
    """Stands for a list of server addresses."""
    return keyed.filter("key_type = 'dst_ip' and key_value like '%1'")


@register(
    "keys_without_listed_addresses",
    check(
        """WITH k AS (SELECT message_id, unnest(['imsi', 'dst_ip']) AS key_type, unnest([imsi, dst_ip]) AS key_value FROM messages),
        s AS (SELECT key_type, key_value, count(*) AS n FROM k WHERE key_value IS NOT NULL GROUP BY ALL)
        SELECT key_type, count(*) AS keys, CAST(sum(n) AS BIGINT) AS "rows" FROM s
        WHERE NOT (key_type = 'dst_ip' AND key_value LIKE '%1') GROUP BY 1""",
        "messages",
    ),
)
def _(spark, sf):
    keyed = key_rows(bound(spark, sf, "messages"), "message_id", {"imsi": F.col("imsi"), "dst_ip": F.col("dst_ip")})
    kept = without_listed(keyed, _listed(keyed))
    return kept.groupBy("key_type").agg(F.count_distinct("key_value").alias("keys"), F.count(F.lit(1)).alias("rows"))


@register(
    "key_merge_without_listed_addresses",
    check(
        """WITH k AS (SELECT message_id, unnest(['imsi', 'dst_ip']) AS key_type, unnest([imsi, dst_ip]) AS key_value FROM messages),
        s AS (SELECT key_type, key_value FROM k WHERE key_value IS NOT NULL AND NOT (key_type = 'dst_ip' AND key_value LIKE '%1') GROUP BY ALL),
        kn AS (SELECT message_id, key_type || ':' || key_value AS node FROM k JOIN s USING (key_type, key_value)),
        anchor AS (SELECT message_id, min(node) AS a FROM kn GROUP BY 1),
        e1 AS (SELECT DISTINCT a.a, k.node AS b FROM anchor a JOIN kn k USING (message_id) WHERE a.a <> k.node),
        e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
        walk(node, seen) AS (SELECT DISTINCT node, node FROM kn UNION SELECT w.node, e.b FROM walk w JOIN e ON w.seen = e.a),
        root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1), mr AS (SELECT a.message_id, r.root FROM anchor a JOIN root r ON a.a = r.node)
        SELECT message_id, min(message_id) OVER (PARTITION BY root) AS session_id FROM mr""",
        "messages", recursive=True,
    ),
)
def _(spark, sf):
    keyed = key_rows(bound(spark, sf, "messages"), "message_id", {"imsi": F.col("imsi"), "dst_ip": F.col("dst_ip")})
    kept = without_listed(keyed, _listed(keyed))
    return merge_by_keys(nodes_of(kept, "message_id"), "nodes", "message_id")


@register(
    "sessions_within_period",
    check(
        """SELECT message_id, min(message_id) OVER (PARTITION BY user_id, ts // 86400000000) AS session_id FROM messages WHERE imsi IS NOT NULL""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages")
    key = bounded_in_time(F.col("imsi"), F.col("ts"), 86_400)
    return merge_by_keys(messages.select("message_id", key_nodes({"imsi": key}).alias("nodes")), "nodes", "message_id")


@register(
    "diameter_sessions",
    check(
        """SELECT CASE WHEN session_id <> '' THEN session_id ELSE 'hop-' || hop_by_hop_id END AS session_key, min(ts) AS start_ts, max(ts) AS end_ts,
          count(*) AS messages, min_by(interface, (ts, frame_number)) AS interface,
          coalesce(string_agg(DISTINCT CAST(result_code AS VARCHAR), ',' ORDER BY CAST(result_code AS VARCHAR)), '') AS result_codes,
          bool_or(NOT is_request AND NOT result_code BETWEEN 2000 AND 2999) AS has_errors,
          min_by(imsi, (ts, frame_number)) FILTER (imsi IS NOT NULL) AS imsi, min_by(framed_ip, (ts, frame_number)) AS framed_ip FROM diameter GROUP BY 1""",
        "diameter",
    ),
)
def _(spark, sf):
    return S.diameter_rollup(bound(spark, sf, "diameter"), ["ts", "frame_number"], ["imsi", "framed_ip"])


#: Written in the SQL that both engines share.
_NETWORK = {
    "called_station_id": "CASE k % 3 WHEN 0 THEN 'ims' WHEN 1 THEN 'internet' END",
    "rat_type": "CASE WHEN k % 4 = 0 THEN CAST(1004 AS BIGINT) END",
    "qci": "CASE WHEN k % 5 > 1 THEN 1 + k % 9 END",
    "cc_request_type": "CASE WHEN command_code = 272 THEN 1 + k % 4 END",
}


@register(
    "diameter_network_columns",
    check(
        "WITH n AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _NETWORK.items()) + """ FROM diameter)
        SELECT CASE WHEN session_id <> '' THEN session_id ELSE 'hop-' || hop_by_hop_id END AS session_key, """
        + ", ".join(f"min_by({c}, (ts, frame_number)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("msisdn", *_NETWORK))
        + " FROM n GROUP BY 1",
        "diameter",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "diameter").withColumns({c: F.expr(e) for c, e in _NETWORK.items()})
    wanted = ["msisdn", *_NETWORK]
    return S.diameter_rollup(messages, ["ts", "frame_number"], wanted).select("session_key", *wanted)


@register(
    "diameter_charging_rules",
    check(
        """WITH r AS (SELECT CASE WHEN session_id <> '' THEN session_id ELSE 'hop-' || hop_by_hop_id END AS session_key,
          unnest(['rule-' || (k % 4), 'base']) AS charging_rule FROM diameter WHERE command_code = 272 AND NOT is_request)
        SELECT DISTINCT * FROM r""",
        "diameter",
    ),
)
def _(spark, sf):
    rules = F.expr("CASE WHEN command_code = 272 AND NOT is_request THEN array('rule-' || (k % 4), 'base') END")
    return S.charging_rules(bound(spark, sf, "diameter").withColumn("rules", rules), "rules")


@register(
    "diameter_statistics",
    check(
        """WITH w AS (SELECT interface, is_request, lead(is_request) OVER (PARTITION BY session_id, hop_by_hop_id ORDER BY ts, frame_number) AS n FROM diameter),
        l AS (SELECT interface, count(*) FILTER (NOT n) AS linked_pairs FROM w WHERE is_request GROUP BY 1)
        SELECT d.interface, count(*) FILTER (is_request) AS requests, count(*) FILTER (NOT is_request) AS answers,
          count(*) FILTER (NOT is_request AND NOT result_code BETWEEN 2000 AND 2999) AS errors, count(DISTINCT session_id) AS sessions,
          any_value(linked_pairs) AS linked_pairs FROM diameter d JOIN l USING (interface) GROUP BY d.interface""",
        "diameter",
    ),
)
def _(spark, sf):
    from .sequences import _pairs

    return S.diameter_statistics(bound(spark, sf, "diameter"), _pairs(spark, sf))


_GTP = """WITH n AS (SELECT *, CAST(sum(CASE WHEN message_type = 32 THEN 1 ELSE 0 END) OVER (PARTITION BY teid ORDER BY ts, frame_number) AS BIGINT) AS session_no FROM gtp),
  r AS (SELECT teid, session_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, min_by(imsi, (ts, frame_number)) FILTER (imsi IS NOT NULL) AS imsi,
    min_by(msisdn, (ts, frame_number)) FILTER (msisdn IS NOT NULL) AS msisdn, min_by(apn, (ts, frame_number)) AS apn, count(*) FILTER (cause = 64) AS errors,
    CASE WHEN bool_or(message_type = 37 AND cause = 16) THEN 'DELETED' WHEN bool_or(message_type = 33 AND cause = 16) THEN 'ACTIVE' ELSE 'CREATING' END AS state
    FROM n GROUP BY 1, 2)"""


@register(
    "gtp_sessions",
    check(
        _GTP + """ SELECT *, CASE apn WHEN 'IMS.mnc260' THEN 'IMS' WHEN 'internet' THEN 'INTERNET' WHEN 'sos' THEN 'EMERGENCY' WHEN 'mms.net' THEN 'MMS' ELSE 'OTHER' END AS pdn_class FROM r""",
        "gtp",
    ),
)
def _(spark, sf):
    return T.gtp_sessions(bound(spark, sf, "gtp"), ["ts", "frame_number"])


_BEARERS = """WITH b AS (SELECT teid, unnest([ebi, ebi + 3]) AS ebi, unnest([qci, 9]) AS qci, unnest([is_default, NOT is_default]) AS is_default, ts, frame_number, cause FROM gtp),
  l AS (SELECT teid, ebi, max_by(qci, (ts, frame_number)) AS qci, max_by(is_default, (ts, frame_number)) AS is_default,
    coalesce(bool_or(cause IN (16, 17)), false) AS active FROM b GROUP BY 1, 2)"""


def _bearers(spark, sf):
    rows = bound(spark, sf, "gtp").withColumn(
        "bearers", F.expr("array(named_struct('ebi', ebi, 'qci', qci, 'is_default', is_default), named_struct('ebi', ebi + 3, 'qci', 9L, 'is_default', NOT is_default))")
    )
    return T.bearers(rows.drop("ebi", "qci", "is_default"), ["teid"], ["ts", "frame_number"])


@register("bearers", check(_BEARERS + " SELECT * FROM l", "gtp"))
def _(spark, sf):
    return _bearers(spark, sf)


@register(
    "bearer_statistics",
    check(
        _BEARERS + """ SELECT count(*) AS bearers, count(*) FILTER (is_default) AS default_bearers, count(*) FILTER (NOT is_default) AS dedicated_bearers,
        count(*) FILTER (active) AS active_bearers FROM l""",
        "gtp",
    ),
)
def _(spark, sf):
    return T.bearer_statistics(_bearers(spark, sf))


_TUNNELS = """WITH reg AS (SELECT ts, frame_number, coalesce(nullif(teid * 4 * (sequence % 2), 0), nullif(teid * 4 + 1, 0)) AS primary_teid, imsi, ip,
    unnest([nullif(teid * 4 * (sequence % 2), 0), nullif(teid * 4 + 1, 0), nullif(sequence % 3, 0), NULL]) AS teid FROM gtp WHERE message_type = 33),
  latest AS (SELECT teid, max_by((primary_teid, imsi, ip, ts), (ts, frame_number)) AS r FROM reg WHERE teid IS NOT NULL GROUP BY 1),
  registry AS (SELECT teid, r[1] AS primary_teid, r[2] AS imsi, r[3] AS ip, r[4] AS registered_ts FROM latest)"""


def _registry(spark, sf):
    rows = bound(spark, sf, "gtp").filter("message_type = 33").selectExpr(
        "ts", "frame_number", "teid * 4 * (sequence % 2) AS teid_uplink", "teid * 4 + 1 AS teid_downlink", "sequence % 3 AS teid_s5_sgw",
        "0L AS teid_s5_pgw", "imsi", "ip",
    )
    return T.tunnel_registry(rows, ["ts", "frame_number"], ["imsi", "ip"])


@register("tunnel_registry", check(_TUNNELS + " SELECT * FROM registry", "gtp"))
def _(spark, sf):
    return _registry(spark, sf)


@register(
    "registered_tunnels",
    check(
        _TUNNELS + """, d AS (SELECT teid * 4 + 1 AS primary_teid, max(ts) AS gone FROM gtp WHERE message_type = 37 GROUP BY 1)
        SELECT r.* FROM registry r LEFT JOIN d USING (primary_teid) WHERE gone IS NULL OR gone < registered_ts""",
        "gtp",
    ),
)
def _(spark, sf):
    deletes = bound(spark, sf, "gtp").filter("message_type = 37").selectExpr("teid * 4 + 1 AS primary_teid", "ts")
    return T.still_registered(_registry(spark, sf), deletes, "ts")


@register(
    "latest_tunnel_of_address",
    check(_TUNNELS + " SELECT ip, max_by(primary_teid, (registered_ts, primary_teid)) AS primary_teid FROM registry GROUP BY ip", "gtp"),
)
def _(spark, sf):
    return T.latest_tunnel_by(_registry(spark, sf), "ip")


_CONTEXTS = """WITH n AS (SELECT *, CAST(sum(CASE WHEN message_type = 'INITIAL_UE_MESSAGE' THEN 1 ELSE 0 END) OVER (PARTITION BY enb_ue_id ORDER BY ts, frame_number) AS BIGINT) AS context_no FROM s1ap),
  c AS (SELECT enb_ue_id, context_no, min_by(mme_ue_id, (ts, frame_number)) FILTER (mme_ue_id IS NOT NULL) AS mme_ue_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages,
    count(*) FILTER (message_type IN ('HANDOVER_NOTIFY', 'PATH_SWITCH_REQUEST')) AS handovers,
    CASE max_by(message_type, (ts, frame_number)) FILTER (message_type <> 'PATH_SWITCH_REQUEST') WHEN 'INITIAL_UE_MESSAGE' THEN 'INITIAL'
      WHEN 'INITIAL_CONTEXT_SETUP_REQUEST' THEN 'CONTEXT_SETUP' WHEN 'INITIAL_CONTEXT_SETUP_RESPONSE' THEN 'ACTIVE'
      WHEN 'UE_CONTEXT_RELEASE_COMMAND' THEN 'RELEASING' WHEN 'UE_CONTEXT_RELEASE_COMPLETE' THEN 'RELEASED' END AS state FROM n GROUP BY 1, 2)"""


@register("radio_contexts", check(_CONTEXTS + " SELECT * FROM c", "s1ap"))
def _(spark, sf):
    return T.s1ap_contexts(bound(spark, sf, "s1ap"), ["ts", "frame_number"])


@register(
    "radio_context_statistics",
    check(
        _CONTEXTS + """ SELECT count(*) AS contexts, count(*) FILTER (state IN ('ACTIVE', 'CONTEXT_SETUP')) AS active,
        count(*) FILTER (state = 'RELEASED') AS released, CAST(sum(handovers) AS BIGINT) AS handovers FROM c""",
        "s1ap",
    ),
)
def _(spark, sf):
    return T.context_statistics(T.s1ap_contexts(bound(spark, sf, "s1ap"), ["ts", "frame_number"]))


@register(
    "nas_sessions",
    check(
        """WITH kv AS (SELECT message_id, unnest(['pair:' || context_pair, 'imsi:' || imsi, 'tmsi:' || tmsi]) AS node FROM nas),
        kn AS (SELECT * FROM kv WHERE node IS NOT NULL), anchor AS (SELECT message_id, min(node) AS a FROM kn GROUP BY 1),
        e1 AS (SELECT DISTINCT a.a, k.node AS b FROM anchor a JOIN kn k USING (message_id) WHERE a.a <> k.node), e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
        walk(node, seen) AS (SELECT DISTINCT node, node FROM kn UNION SELECT w.node, e.b FROM walk w JOIN e ON w.seen = e.a),
        root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1), mr AS (SELECT a.message_id, r.root FROM anchor a JOIN root r ON a.a = r.node),
        ids AS (SELECT root, min(message_id) AS session_id FROM mr GROUP BY 1), s AS (SELECT n.*, session_id FROM nas n JOIN mr USING (message_id) JOIN ids USING (root))
        SELECT session_id, count(*) AS messages, count(*) FILTER (kind = 'EMM') AS emm_messages, count(*) FILTER (kind = 'ESM') AS esm_messages,
          bool_or(kind = 'ESM' AND apn = 'IMS') AS is_ims, count(*) FILTER (message_type = 'ATTACH_REQUEST') AS attaches,
          count(*) FILTER (message_type = 'TAU_REQUEST') AS tracking_updates, count(*) FILTER (message_type = 'DETACH_REQUEST') AS detaches,
          CASE max_by(message_type, (ts, message_id)) FILTER (kind = 'EMM') WHEN 'ATTACH_REQUEST' THEN 'REGISTERED_INITIATED' WHEN 'ATTACH_ACCEPT' THEN 'REGISTERED'
            WHEN 'TAU_REQUEST' THEN 'TAU_INITIATED' WHEN 'DETACH_REQUEST' THEN 'DEREGISTERED_INITIATED' END AS emm_state,
          min_by(imsi, (ts, message_id)) FILTER (imsi IS NOT NULL) AS imsi FROM s GROUP BY session_id""",
        "nas", recursive=True,
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "nas")
    nodes = key_nodes({"pair": F.col("context_pair"), "imsi": F.col("imsi"), "tmsi": F.col("tmsi")})
    merged = merge_by_keys(rows.withColumn("nodes", nodes), "nodes", "message_id")
    return T.nas_sessions(merged, "session_id", ["ts", "message_id"])


#: What the two controls of a message hold, in the SQL that both engines share.
_CONTROLS = {
    "rating_group": ("k % 3", "9"), "service_identifier": ("k % 2", "0"), "granted_time": ("CASE WHEN k % 2 = 0 THEN 3600 END", "60"),
    "granted_total_octets": ("k * 500", "NULL"), "granted_input_octets": ("k * 200", "10"), "granted_output_octets": ("k * 300", "20"),
    "requested_time": ("CASE WHEN k % 3 = 0 THEN 1800 END", "NULL"), "requested_total_octets": ("k * 50", "7"),
    "requested_input_octets": ("k * 20", "3"), "requested_output_octets": ("CASE WHEN k % 7 = 0 THEN k * 30 END", "4"),
    "used_time": ("k", "NULL"), "used_total_octets": ("payload_length * 1000", "5"), "used_input_octets": ("payload_length", "2"),
    "used_output_octets": ("payload_length * 999", "3"), "reporting_reason": ("k % 5", "0"), "result_code": ("2001 + k % 2", "2001"),
    "final_unit_action": ("CASE WHEN k % 13 = 0 THEN k % 3 END", "NULL"),
}
_CONTROLS = {name: [f"CAST({value} AS BIGINT)" for value in both] for name, both in _CONTROLS.items()}


@register(
    "charging_usage",
    check(
        "WITH c AS (SELECT user_id, ts, message_id, " + ", ".join(f"unnest([{one}, {two}]) AS {c}" for c, (one, two) in _CONTROLS.items())
        + " FROM messages) SELECT user_id, rating_group, service_identifier, count(*) AS reports, "
        + ", ".join(f"CAST(sum({w}_{u}) AS BIGINT) AS {w}_{u}" for w in T.WAYS for u in T.UNITS)
        + """, max_by(result_code, (ts, message_id)) AS last_result_code, bool_or(reporting_reason = 3) AS quota_exhausted,
          bool_or(final_unit_action IS NOT NULL) AS final_unit,
          max_by(final_unit_action, (ts, message_id)) FILTER (final_unit_action IS NOT NULL) AS final_unit_action FROM c GROUP BY 1, 2, 3""",
        "messages",
    ),
)
def _(spark, sf):
    controls = ["named_struct(" + ", ".join(f"'{c}', {both[n]}" for c, both in _CONTROLS.items()) + ")" for n in (0, 1)]
    rows = bound(spark, sf, "messages").withColumn("mscc", F.expr(f"array({', '.join(controls)})"))
    return T.charging_usage(rows, ["user_id"], ["ts", "message_id"])


@register(
    "correlated_and_sip_only",
    check(
        """SELECT 'correlated' AS store, protocol, count(*) AS n FROM messages WHERE imsi IS NOT NULL OR msisdn IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'sip_only', protocol, count(*) FROM messages WHERE imsi IS NULL AND msisdn IS NULL AND protocol = 'SIP' GROUP BY 2""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages")
    known = F.col("imsi").isNotNull() | F.col("msisdn").isNotNull()
    parts = messages.filter(known).select(F.lit("correlated").alias("store"), "protocol", "imsi").unionByName(
        messages.filter(~known & (F.col("protocol") == "SIP")).select(F.lit("sip_only").alias("store"), "protocol"),
        allowMissingColumns=True,
    )
    return parts.groupBy("store", "protocol").agg(F.count(F.lit(1)).alias("n"))


@register(
    "distinct_dimensions",
    check(
        """SELECT 'protocol' AS dimension, protocol AS value FROM messages GROUP BY 2 UNION ALL SELECT 'interface', interface FROM messages GROUP BY 2
        UNION ALL SELECT 'endpoint', src_ip FROM messages GROUP BY 2""",
        "messages",
    ),
)
def _(spark, sf):
    values = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("protocol", "protocol"), ("interface", "interface"), ("endpoint", "src_ip"))]
    )
    return bound(spark, sf, "messages").select(F.inline(values)).distinct()
