"""Call-flow queries: flows out of SIP sessions and the legs of the other protocols, their lookups and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import uri_user
from ..operators import calls as C
from ..operators import diagram as D
from ..operators import filters as FI
from ..operators import flows as FL
from ..operators import media as M
from ..operators import sessions as S
from ..operators import tunnels as T
from ..operators.components import key_nodes, merge_by_keys
from ..session import cut_lineage
from .bindings import bound, check
from .calls import _KPIS, _SIP, _STATES, _states
from .media import _QUALITY
from .registry import register

ORDER = ["ts", "frame_number"]
BINDINGS = ("sip", "diameter", "gtp", "nas", "rtp", "identities")
CALLS = "('VOICE_CALL', 'VIDEO_CALL', 'EMERGENCY_CALL')"


def _number_keys(text: str) -> str:
    """All numbers of the given tables have the one-digit country code 1."""
    digits = f"regexp_replace(coalesce({text}, ''), '[^0-9]', '', 'g')"
    return f"CASE WHEN {digits} <> '' THEN 'number:' || substr({digits}, 2) END, CASE WHEN length({digits}) >= 9 THEN 'ending:' || right({digits}, 9) END"


def _told(party: str) -> str:
    """The smallest subscriber of the number in the registry, by its national form, else by its ending."""
    one, two = _number_keys(party).split(", CASE WHEN length", 1)
    return f"coalesce((SELECT imsi FROM reg WHERE key = {one}), (SELECT imsi FROM reg WHERE key = CASE WHEN length{two}))"


def _claims(name: str, legs: str, rank: str) -> str:
    return f"""{name}_cand AS (SELECT l.leg_id, p.call_id, row_number() OVER (PARTITION BY l.leg_id ORDER BY {rank}, p.start_ts, p.call_id) AS n
    FROM (SELECT leg_id, kind, start_ts, end_ts, unnest(keys) AS key FROM legs WHERE {legs}) l JOIN {name}_parties p USING (key)
    WHERE p.end_ts >= l.start_ts - CASE kind WHEN 'Gx' THEN 5 WHEN 'Rx' THEN 2 WHEN 'Cx' THEN 30 WHEN 'Sh' THEN 30 WHEN 'RTP' THEN 0 ELSE 3 END * 1000000
      AND p.start_ts <= CASE kind WHEN 'RTP' THEN l.end_ts ELSE l.start_ts END
        + CASE kind WHEN 'Gx' THEN 5 WHEN 'Rx' THEN 2 WHEN 'Cx' THEN 30 WHEN 'Sh' THEN 30 WHEN 'RTP' THEN 0 ELSE 3 END * 1000000),
  {name} AS (SELECT leg_id, call_id FROM {name}_cand WHERE n = 1)"""


_LEGS = f"""dia AS (SELECT CASE WHEN session_id <> '' THEN session_id ELSE 'hop-' || hop_by_hop_id END AS k0, min_by(interface, (ts, frame_number)) AS kind,
    min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, min_by(imsi, (ts, frame_number)) FILTER (imsi IS NOT NULL) AS imsi,
    min_by(framed_ip, (ts, frame_number)) AS ip, min_by(msisdn, (ts, frame_number)) FILTER (msisdn IS NOT NULL) AS msisdn FROM diameter GROUP BY 1),
  gtpn AS (SELECT *, CAST(sum(CASE WHEN message_type = 32 THEN 1 ELSE 0 END) OVER (PARTITION BY teid ORDER BY ts, frame_number) AS BIGINT) AS session_no FROM gtp),
  gtps AS (SELECT teid, session_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, min_by(imsi, (ts, frame_number)) FILTER (imsi IS NOT NULL) AS imsi,
    min_by(msisdn, (ts, frame_number)) FILTER (msisdn IS NOT NULL) AS msisdn FROM gtpn GROUP BY 1, 2 HAVING bool_or(NOT is_default)),
  nass AS (WITH RECURSIVE kv AS (SELECT message_id, unnest(['pair:' || context_pair, 'imsi:' || imsi, 'tmsi:' || tmsi]) AS node FROM nas),
    kn AS (SELECT * FROM kv WHERE node IS NOT NULL), anchor AS (SELECT message_id, min(node) AS a FROM kn GROUP BY 1),
    e1 AS (SELECT DISTINCT a.a, k.node AS b FROM anchor a JOIN kn k USING (message_id) WHERE a.a <> k.node), e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
    walk(node, seen) AS (SELECT DISTINCT node, node FROM kn UNION SELECT w.node, e.b FROM walk w JOIN e ON w.seen = e.a),
    root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1), mr AS (SELECT a.message_id, r.root FROM anchor a JOIN root r ON a.a = r.node),
    ids AS (SELECT root, min(message_id) AS session_id FROM mr GROUP BY 1)
    SELECT session_id, min(ts) FILTER (kind = 'ESM') AS start_ts, max(ts) FILTER (kind = 'ESM') AS end_ts, count(*) FILTER (kind = 'ESM') AS messages,
      min_by(imsi, (ts, message_id)) FILTER (imsi IS NOT NULL) AS imsi
    FROM nas JOIN mr USING (message_id) JOIN ids USING (root) GROUP BY 1 HAVING bool_or(kind = 'ESM' AND apn = 'IMS')),
  str AS ({_QUALITY} SELECT s.*, a.start_ts, a.end_ts, a.src_ip, a.dst_ip FROM s JOIN (SELECT ssrc, min(ts) AS start_ts, max(ts) AS end_ts,
    min_by(src_ip, (ts, frame_number)) AS src_ip, min_by(dst_ip, (ts, frame_number)) AS dst_ip FROM rtp GROUP BY 1) a USING (ssrc)),
  legs0 AS (SELECT 'd:' || k0 AS leg_id, kind, start_ts, end_ts, CASE WHEN kind IN ('Gx', 'Rx') THEN ['address:' || ip] ELSE [{_number_keys("msisdn")}] END AS keys,
      imsi, msisdn AS number, messages, NULL::DOUBLE AS loss_rate, NULL::DOUBLE AS jitter_ms, NULL::DOUBLE AS mos FROM dia
    UNION ALL SELECT 'g:' || teid || ':' || session_no, 'GTP', start_ts, end_ts, [{_number_keys("msisdn")}], imsi, msisdn, messages, NULL, NULL, NULL FROM gtps
    UNION ALL SELECT 'n:' || session_id, 'NAS', start_ts, end_ts, ['imsi:' || imsi], imsi, NULL, messages, NULL, NULL, NULL FROM nass
    UNION ALL SELECT 'r:' || ssrc, 'RTP', start_ts, end_ts, ['address:' || src_ip, 'address:' || dst_ip], NULL, NULL, packets_received, loss_rate, jitter_ms, mos FROM str),
  legs AS (SELECT * REPLACE (list_distinct(list_filter(keys, lambda x: x IS NOT NULL)) AS keys) FROM legs0)"""

_FLOWS = f"""WITH sess AS ({_SIP} SELECT c.*, f.forward_target FROM calls c JOIN (SELECT call_id,
    min_by(regexp_extract(forward_uri, 'sip:([^@]+)@', 1), (ts, frame_number)) FILTER (forward_uri IS NOT NULL) AS forward_target FROM sip GROUP BY 1) f USING (call_id)),
  {_LEGS},
  reg AS (SELECT key, min(imsi) AS imsi FROM (SELECT imsi, unnest([{_number_keys("msisdn")}]) AS key FROM identities WHERE imsi IS NOT NULL AND msisdn IS NOT NULL)
    WHERE key IS NOT NULL GROUP BY 1),
  c0 AS (SELECT *, {_told("caller")} AS caller0, {_told("callee")} AS callee0, {_told("forward_target")} AS forward0 FROM sess WHERE session_type IN {CALLS}),
  one_parties AS (SELECT DISTINCT * FROM (SELECT call_id, start_ts, end_ts, unnest([{_number_keys("caller")}, {_number_keys("callee")},
    'address:' || caller_ip, 'address:' || callee_ip]) AS key FROM c0) WHERE key IS NOT NULL),
  {_claims("one", "kind <> 'NAS'", "CASE WHEN key LIKE 'address:%' THEN 1 ELSE 0 END")},
  gt AS (SELECT o.call_id, l.start_ts, l.leg_id, l.imsi, l.keys FROM one o JOIN legs l USING (leg_id) WHERE l.kind = 'GTP' AND l.imsi IS NOT NULL AND l.number IS NOT NULL),
  tl AS (SELECT c.call_id, min_by(g.imsi, (g.start_ts, g.leg_id)) FILTER (list_has_any(g.keys, [{_number_keys("c.caller")}])) AS a,
    min_by(g.imsi, (g.start_ts, g.leg_id)) FILTER (list_has_any(g.keys, [{_number_keys("c.callee")}])) AS b,
    min_by(g.imsi, (g.start_ts, g.leg_id)) FILTER (list_has_any(g.keys, [{_number_keys("c.forward_target")}])) AS f FROM c0 c JOIN gt g USING (call_id) GROUP BY 1),
  c1 AS (SELECT c.* EXCLUDE (caller0, callee0, forward0), coalesce(caller0, a) AS caller_imsi, coalesce(callee0, b) AS callee_imsi, coalesce(forward0, f) AS forward_imsi
    FROM c0 c LEFT JOIN tl USING (call_id)),
  two_parties AS (SELECT DISTINCT * FROM (SELECT call_id, start_ts, end_ts, unnest(['imsi:' || caller_imsi, 'imsi:' || callee_imsi]) AS key FROM c1) WHERE key IS NOT NULL),
  {_claims("two", "kind = 'NAS'", "0")},
  claimed AS (SELECT * FROM one UNION ALL SELECT * FROM two),
  tot AS (SELECT call_id, """ + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.lower()}_legs" for k in C.LEG_TOLERANCE) + f""",
    sum(messages) FILTER (kind IN ('Gx', 'Rx', 'Cx', 'Sh')) AS diameter_messages, sum(messages) FILTER (kind = 'GTP') AS gtp_messages,
    sum(messages) FILTER (kind = 'NAS') AS nas_messages, sum(messages) FILTER (kind = 'RTP') AS rtp_packets,
    max(CASE WHEN loss_rate > 0 THEN loss_rate * 100 END) AS max_loss_percent, avg(CASE WHEN jitter_ms > 0 THEN jitter_ms END) AS jitter_ms, min(CASE WHEN mos > 0 THEN mos END) AS mos
    FROM claimed JOIN legs USING (leg_id) GROUP BY 1),
  every AS (SELECT * FROM c1 UNION ALL BY NAME SELECT * REPLACE (NULL AS caller, NULL AS callee, NULL AS caller_ip, NULL AS callee_ip, NULL AS forward_target) FROM sess
    WHERE session_type NOT IN {CALLS}),
  flows AS (SELECT (start_ts // 1000000) || '.' || lpad(CAST(start_ts % 1000000 AS VARCHAR), 6, '0') || CASE WHEN session_type IN {CALLS} THEN '_V_' ELSE '_V_SIP_' END || call_id AS flow_id,
    CASE WHEN session_type IN {CALLS} THEN CASE WHEN forward_target IS NOT NULL THEN 'VOICE_CALL_FORWARDING' WHEN session_type = 'VIDEO_CALL' THEN 'MO_VIDEO_CALL' ELSE 'MO_VOICE_CALL' END
      WHEN session_type = 'REGISTRATION' THEN 'IMS_REGISTRATION' WHEN session_type = 'SMS_MESSAGE' THEN 'MO_SMS' ELSE 'UNKNOWN' END AS flow_type,
    call_id, session_type, caller, callee, forward_target, caller_ip, callee_ip, caller_imsi, callee_imsi, forward_imsi, start_ts, end_ts, messages AS sip_messages, """ + ", ".join(
    f"coalesce({k.lower()}_legs, 0) AS {k.lower()}_legs" for k in C.LEG_TOLERANCE
) + """, CAST(coalesce(diameter_messages, 0) AS BIGINT) AS diameter_messages,
    CAST(coalesce(gtp_messages, 0) AS BIGINT) AS gtp_messages, CAST(coalesce(nas_messages, 0) AS BIGINT) AS nas_messages, CAST(coalesce(rtp_packets, 0) AS BIGINT) AS rtp_packets,
    round(max_loss_percent, 6) AS max_loss_percent, round(jitter_ms, 2) AS jitter_ms, round(mos, 6) AS mos FROM every LEFT JOIN tot USING (call_id))"""

COLUMNS = (
    "flow_id", "flow_type", "call_id", "session_type", *FL.PARTIES, "caller_ip", "callee_ip", "caller_imsi", "callee_imsi", "forward_imsi", "start_ts", "end_ts",
    "sip_messages", *[f"{k.lower()}_legs" for k in C.LEG_TOLERANCE], "diameter_messages", "gtp_messages", "nas_messages", "rtp_packets", "max_loss_percent", "jitter_ms", "mos",
)
SHORT = ("flow_id", "flow_type", "caller", "callee", "start_ts")


def _flow_check(body: str) -> str:
    return check(_FLOWS + " " + body, *BINDINGS, recursive=True)


def _sessions(spark, sf) -> DataFrame:
    sip = bound(spark, sf, "sip").withColumn("forward_target", F.when(F.col("forward_uri").isNotNull(), uri_user("forward_uri")))
    return C.sip_sessions(sip, "call_id", ORDER, also=["forward_target"])


def _legs(spark, sf) -> DataFrame:
    """Diameter sessions, GTP sessions with dedicated bearers, NAS session management for IMS, and media streams."""
    diameter = S.diameter_rollup(bound(spark, sf, "diameter"), ORDER, ["imsi", "framed_ip", "msisdn"])
    by_address = F.col("interface").isin("Gx", "Rx")
    keys = F.when(by_address, FL.key_list(FL.address_key(F.col("framed_ip")))).otherwise(FL.number_key_list(F.col("msisdn")))
    legs = FL.legs_of(diameter, F.concat(F.lit("d:"), "session_key"), F.col("interface"), keys, F.col("imsi"), F.col("msisdn"))

    gtp = T.numbered_sessions(bound(spark, sf, "gtp").drop("sequence", "qci", "ebi", "ip", "bytes"), ORDER)
    tunnels = T.session_totals(gtp, ORDER, dedicated=F.bool_or(~F.col("is_default"))).filter("dedicated")
    tunnel_id = F.concat_ws(":", F.lit("g"), "teid", "session_no")
    legs = legs.unionByName(FL.legs_of(tunnels, tunnel_id, F.lit("GTP"), FL.number_key_list(F.col("msisdn")), F.col("imsi"), F.col("msisdn")))

    nas = bound(spark, sf, "nas")
    nodes = key_nodes({"pair": F.col("context_pair"), "imsi": F.col("imsi"), "tmsi": F.col("tmsi")})
    # Written once: the merge reads its rows three times.
    merged = merge_by_keys(cut_lineage(nas.withColumn("nodes", nodes), "nas"), "nodes", "message_id")
    esm = F.when(F.col("kind") == "ESM", F.col("ts"))
    managed = merged.groupBy("session_id").agg(
        F.min(esm).alias("start_ts"), F.max(esm).alias("end_ts"), F.count(esm).alias("messages"),
        F.bool_or((F.col("kind") == "ESM") & F.lower("apn").contains("ims")).alias("ims"), S.first_known("imsi", ["ts", "message_id"]).alias("imsi"),
    ).filter("ims")
    legs = legs.unionByName(
        FL.legs_of(managed, F.concat_ws(":", F.lit("n"), "session_id"), F.lit("NAS"), FL.key_list(FL.imsi_key(F.col("imsi"))), F.col("imsi"))
    )

    return legs.unionByName(_media_legs(spark, sf))


def _media_legs(spark, sf) -> DataFrame:
    packets = bound(spark, sf, "rtp")
    spans = packets.groupBy("ssrc").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), *[F.min_by(c, F.struct(*ORDER)).alias(c) for c in ("src_ip", "dst_ip")]
    )
    streams = M.stream_quality(packets, ["ssrc"], ORDER).join(spans, "ssrc")
    ends = FL.key_list(FL.address_key(F.col("src_ip")), FL.address_key(F.col("dst_ip")))
    return FL.legs_of(streams, F.concat_ws(":", F.lit("r"), "ssrc"), F.lit("RTP"), ends, messages="packets_received", media=True)


def _registry(spark, sf) -> DataFrame:
    return bound(spark, sf, "identities").filter("imsi is not null and msisdn is not null").select(F.col("msisdn").alias("number"), "imsi")


def _flows(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flows, the legs each claimed, and all legs."""
    flows, claimed, legs = FL.assemble(_sessions(spark, sf), _legs(spark, sf), _registry(spark, sf))
    digits = {"max_loss_percent": 6, "jitter_ms": 2, "mos": 6}
    return flows.withColumns({c: F.round(c, n) for c, n in digits.items()}).select(*COLUMNS), claimed, legs


@register("call_flows", _flow_check("SELECT * FROM flows"))
def _(spark, sf):
    return _flows(spark, sf)[0]


@register("claimed_legs", _flow_check("SELECT leg_id, call_id, kind FROM claimed JOIN legs USING (leg_id)"))
def _(spark, sf):
    return _flows(spark, sf)[1]


@register("uncorrelated_remainder", _flow_check("SELECT kind, count(*) AS n FROM legs WHERE leg_id NOT IN (SELECT leg_id FROM claimed) GROUP BY kind"))
def _(spark, sf):
    _found, claimed, legs = _flows(spark, sf)
    return FI.uncorrelated(legs, claimed, "leg_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register(
    "flow_counts",
    _flow_check(
        """SELECT 'flows' AS what, count(*) AS n FROM flows UNION ALL SELECT 'flows ' || flow_type, count(*) FROM flows GROUP BY 1
        UNION ALL SELECT 'unclaimed ' || kind, count(*) FROM legs WHERE leg_id NOT IN (SELECT leg_id FROM claimed) GROUP BY 1"""
    ),
)
def _(spark, sf):
    flows, claimed, legs = _flows(spark, sf)
    return FL.flow_counts(flows, legs, claimed)


@register(
    "call_statistics",
    check(
        f"""WITH st AS ({_STATES} SELECT * FROM s), kp AS ({_KPIS} SELECT call_id, setup_time_ms FROM kpi), fl AS ({_FLOWS.replace("WITH ", "WITH RECURSIVE ", 1)} SELECT call_id, mos FROM flows)
        SELECT count(*) AS total_calls, count(*) FILTER (state = 'COMPLETED') AS successful_calls, count(*) FILTER (state IN ('FAILED', 'CANCELLED')) AS failed_calls,
        count(*) FILTER (state NOT IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS active_calls, round(avg(CASE WHEN setup_time_ms > 0 THEN setup_time_ms END), 6) AS avg_setup_time_ms,
        round(avg(CASE WHEN mos > 0 THEN mos END), 5) AS avg_mos FROM st JOIN kp USING (call_id) JOIN fl USING (call_id)""",
        *BINDINGS, recursive=True,
    ),
)
def _(spark, sf):
    kpis = C.call_kpis(bound(spark, sf, "sip"), "call_id", "ts").select("call_id", "setup_time_ms")
    rated = FL.ratings(_sessions(spark, sf), _media_legs(spark, sf)).withColumn("mos", F.round("mos", 6))
    calls = _states(spark, sf).join(kpis, "call_id").join(rated, "call_id")
    return C.call_statistics(calls).withColumns({"avg_setup_time_ms": F.round("avg_setup_time_ms", 6), "avg_mos": F.round("avg_mos", 5)})


_SHORT = ", ".join(SHORT)
#: What the lookups ask for: the ids of calls that began with an error of the network, some numbers, subscribers and frames.
_ASKED_IDS = "SELECT flow_id FROM flows WHERE mos < 2"
_ASKED_NUMBERS = ("sip:+12120000033@ims.example.org", "tel:+1-415-000-0004", "16460000005")
_ASKED_FRAMES = "frame_number % 97 = 5"


@register("flows_by_id", _flow_check(f"SELECT {_SHORT} FROM flows WHERE flow_id IN ({_ASKED_IDS})"))
def _(spark, sf):
    flows = cut_lineage(_flows(spark, sf)[0], "flows")
    return FL.flows_by_id(flows, flows.filter("mos < 2").select("flow_id")).select(*SHORT)


@register(
    "flows_by_number",
    _flow_check(
        "SELECT DISTINCT number, " + ", ".join(f"f.{c}" for c in SHORT) + " FROM flows f JOIN (SELECT unnest(["
        + ", ".join(f"'{n}'" for n in _ASKED_NUMBERS)
        + "]) AS number) a ON regexp_replace(split_part(a.number, '@', 1), '[^0-9]', '', 'g') IN (" + ", ".join(f"regexp_replace(f.{p}, '[^0-9]', '', 'g')" for p in FL.PARTIES) + ")"
    ),
)
def _(spark, sf):
    asked = spark.createDataFrame([(n,) for n in _ASKED_NUMBERS], "number string")
    return FL.flows_by_number(_flows(spark, sf)[0], asked).select("number", *SHORT)


_ASKED_SUBSCRIBERS = "SELECT DISTINCT imsi FROM identities WHERE imsi IS NOT NULL AND user_id % 5 = 2"


@register(
    "flows_by_subscriber",
    _flow_check(
        "SELECT DISTINCT a.imsi, " + ", ".join(f"f.{c}" for c in SHORT) + f" FROM flows f JOIN ({_ASKED_SUBSCRIBERS}) a ON a.imsi IN (f.caller_imsi, f.callee_imsi, f.forward_imsi)"
    ),
)
def _(spark, sf):
    asked = bound(spark, sf, "identities").filter("imsi is not null and user_id % 5 = 2").select("imsi")
    return FL.flows_by_subscriber(_flows(spark, sf)[0], asked).select("imsi", *SHORT)


_FRAMES = """fr AS (SELECT DISTINCT f.flow_id, x.protocol, x.frame_number FROM flows f JOIN (SELECT call_id, 'SIP' AS protocol, frame_number FROM sip
    UNION ALL SELECT c.call_id, l.protocol, l.frame_number FROM claimed c JOIN (
      SELECT 'd:' || CASE WHEN session_id <> '' THEN session_id ELSE 'hop-' || hop_by_hop_id END AS leg_id, 'DIAMETER' AS protocol, frame_number FROM diameter
      UNION ALL SELECT 'g:' || teid || ':' || session_no, 'GTP', frame_number FROM gtpn) l USING (leg_id)) x USING (call_id))"""


def _frames(spark, sf, flows: DataFrame, claimed: DataFrame) -> DataFrame:
    diameter = bound(spark, sf, "diameter").select(
        F.concat(F.lit("d:"), S.diameter_session_key()).alias("leg_id"), F.lit("DIAMETER").alias("protocol"), "frame_number"
    )
    gtp = T.numbered_sessions(bound(spark, sf, "gtp").select("teid", *ORDER, "message_type"), ORDER)
    tunnels = gtp.select(F.concat_ws(":", F.lit("g"), "teid", "session_no").alias("leg_id"), F.lit("GTP").alias("protocol"), "frame_number")
    sip = bound(spark, sf, "sip").select("call_id", "frame_number")
    return FL.flow_frames(flows, sip, claimed, diameter.unionByName(tunnels))


@register("flow_frames", check(_FLOWS + ", " + _FRAMES + " SELECT * FROM fr", *BINDINGS, recursive=True))
def _(spark, sf):
    flows, claimed, _every = _flows(spark, sf)
    return _frames(spark, sf, flows, claimed)


@register(
    "flows_by_frame",
    check(
        _FLOWS + ", " + _FRAMES + " SELECT protocol, frame_number, " + ", ".join(f"f.{c}" for c in SHORT) + f" FROM flows f JOIN fr USING (flow_id) WHERE {_ASKED_FRAMES}",
        *BINDINGS, recursive=True,
    ),
)
def _(spark, sf):
    flows, claimed, _every = _flows(spark, sf)
    asked = bound(spark, sf, "sip").filter(_ASKED_FRAMES).select("frame_number")
    return FL.flows_by_frame(flows, _frames(spark, sf, flows, claimed), asked).select("protocol", "frame_number", *SHORT)


@register(
    "voice_and_video_flows",
    _flow_check(
        f"""SELECT 'voice' AS media, {_SHORT} FROM flows WHERE flow_type IN ('MO_VOICE_CALL', 'MT_VOICE_CALL', 'VOICE_CALL_FORWARDING', 'CONFERENCE_CALL')
        UNION ALL SELECT 'video', {_SHORT} FROM flows WHERE flow_type IN ('MO_VIDEO_CALL', 'MT_VIDEO_CALL')"""
    ),
)
def _(spark, sf):
    flows = _flows(spark, sf)[0]
    voice, video = FL.voice_flows(flows), FL.video_flows(flows)
    return voice.select(F.lit("voice").alias("media"), *SHORT).unionByName(video.select(F.lit("video").alias("media"), *SHORT))


@register(
    "call_flow_documents",
    _flow_check(
        """, d AS (SELECT call_id, leg_id, kind, (row_number() OVER (PARTITION BY call_id ORDER BY start_ts, leg_id) - 1) // 4 AS part FROM claimed JOIN legs USING (leg_id)),
        p AS (SELECT call_id, part, count(*) AS legs, string_agg(leg_id, ',' ORDER BY leg_id) AS leg_ids FROM d GROUP BY 1, 2)
        SELECT flow_id, coalesce(part, 0) AS part, CASE WHEN coalesce(part, 0) = 0 THEN flow_type END AS flow_type, CASE WHEN coalesce(part, 0) = 0 THEN caller END AS caller,
          coalesce(legs, 0) AS legs, coalesce(leg_ids, '') AS leg_ids FROM flows LEFT JOIN p USING (call_id)"""
    ).replace("  , d AS", ", d AS"),
)
def _(spark, sf):
    """The documents parsed back: what each part holds."""
    flows, claimed, legs = _flows(spark, sf)
    written = cut_lineage(FL.flow_documents(flows, legs, claimed, part_legs=4), "documents")
    parsed = written.withColumn("d", F.from_json("document", "flow_type string, caller string, legs array<struct<leg_id: string>>"))
    ids = F.coalesce(F.array_sort("d.legs.leg_id"), F.array().cast("array<string>"))
    return parsed.select(
        "flow_id", "part", "d.flow_type", "d.caller", F.size(ids).cast("bigint").alias("legs"), F.array_join(ids, ",").alias("leg_ids")
    )


_DIAGRAM = f"""lt AS (SELECT call_id, min_by(start_ts, (start_ts, leg_id)) FILTER (kind = 'Rx') AS rx_request_ts, arg_min_null(CASE WHEN end_ts > start_ts THEN end_ts END, (start_ts, leg_id)) FILTER (kind = 'Rx') AS rx_answer_ts,
    min_by(start_ts, (start_ts, leg_id)) FILTER (kind = 'Gx') AS gx_request_ts, arg_min_null(CASE WHEN end_ts > start_ts THEN end_ts END, (start_ts, leg_id)) FILTER (kind = 'Gx') AS gx_answer_ts,
    min_by(start_ts, (start_ts, leg_id)) FILTER (kind = 'GTP') AS bearer_request_ts, arg_min_null(CASE WHEN end_ts > start_ts THEN end_ts END, (start_ts, leg_id)) FILTER (kind = 'GTP') AS bearer_response_ts,
    min(start_ts) FILTER (kind = 'RTP') AS media_ts FROM claimed JOIN legs USING (leg_id) GROUP BY 1),
  mi AS (SELECT call_id, min(ts) FILTER (is_request AND method = 'INVITE') AS invite_ts, min(ts) FILTER (NOT is_request AND status_code = 100) AS trying_ts,
    min(ts) FILTER (NOT is_request AND status_code = 180) AS ringing_ts, min(ts) FILTER (NOT is_request AND status_code = 200 AND cseq_method = 'INVITE') AS answer_ts,
    min(ts) FILTER (is_request AND method = 'ACK') AS ack_ts, min(ts) FILTER (is_request AND method = 'BYE') AS bye_ts FROM sip GROUP BY 1),
  mt AS (SELECT * FROM flows JOIN mi USING (call_id) LEFT JOIN lt USING (call_id) WHERE session_type IN {CALLS}),
  st AS (""" + " UNION ALL ".join(
    f"SELECT flow_id, {i} AS place, {time} AS ts, '{a}' AS sender, '{b}' AS receiver, '{p}' AS protocol, '{m}' AS message, "
    + ("'Call-ID: ' || call_id" if time == "invite_ts" else "''") + f" AS details FROM mt WHERE {time} IS NOT NULL"
    for i, (time, a, b, p, m) in enumerate(D.CALL_STEPS)
) + ")"


@register(
    "call_diagrams",
    check(
        _FLOWS + ", " + _DIAGRAM + " SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY ts, place) AS event_no, ts, sender, receiver, protocol, message, details FROM st",
        *BINDINGS, recursive=True,
    ),
)
def _(spark, sf):
    """The diagram of every call: signalling, policy, bearer and media by the legs that it claimed."""
    flows, claimed, legs = _flows(spark, sf)
    calls = flows.filter(F.col("session_type").isin(*C.CALL_TYPES)).select("flow_id", "call_id")
    times = calls.join(C.call_times(bound(spark, sf, "sip"), "call_id", "ts"), "call_id").join(FL.leg_times(claimed, legs), "call_id", "left")
    return D.call_rows(times.withColumn("invite_details", F.concat(F.lit("Call-ID: "), "call_id")), "flow_id")


@register(
    "call_diagram_participants",
    _flow_check(
        f"SELECT flow_id, unnest({list(D.CALL_PARTICIPANTS)}) AS participant, unnest(['UE (' || coalesce(caller, '') || ')', "
        + ", ".join(f"'{n}'" for k, n in D.CALL_PARTICIPANTS.items() if k != "ue") + f"]) AS name FROM flows WHERE session_type IN {CALLS}"
    ),
)
def _(spark, sf):
    flows = _flows(spark, sf)[0].filter(F.col("session_type").isin(*C.CALL_TYPES))
    return D.call_participants(flows, "flow_id", "caller")
