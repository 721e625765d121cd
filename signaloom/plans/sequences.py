"""Sequence and pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import handover as H
from ..operators import keepalive as K
from ..operators import pairing as P
from .bindings import bound, check, table
from .registry import register


@register(
    "sequence_in_leg",
    check(
        "SELECT message_id, user_id, interface, row_number() OVER (PARTITION BY user_id, interface ORDER BY ts, message_id) - 1 AS sequence FROM messages",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").select("message_id", "user_id", "interface", "ts")
    return P.sequence_in_leg(messages, ["user_id", "interface"], ["ts", "message_id"]).drop("ts")


@register(
    "inter_event_gaps",
    check("SELECT message_id, user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS gap_us FROM messages", "messages"),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").select("message_id", "user_id", "ts")
    return P.inter_event_gaps(messages, ["user_id"], ["ts", "message_id"]).drop("ts")


@register(
    "gap_metrics",
    check(
        """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS gap FROM messages)
        SELECT user_id, count(*) AS total_events, (max(ts) - min(ts)) // 1000 AS total_duration_ms,
          coalesce(CAST(sum(gap) AS BIGINT) // nullif(count(*) - 1, 0) // 1000, 0) AS avg_gap_ms FROM g GROUP BY user_id""",
        "messages",
    ),
)
def _(spark, sf):
    return P.gap_metrics(bound(spark, sf, "messages"), ["user_id"], "ts")


_KIND = "CASE event_type WHEN 'view' THEN 'REQ' WHEN 'click' THEN 'RESP' END"


@register(
    "request_latency",
    check(
        f"""WITH r AS (SELECT message_id, user_id, ts, {_KIND} AS kind FROM messages WHERE {_KIND} IS NOT NULL),
        w AS (SELECT *, lag(kind) OVER o AS before, lag(ts) OVER o AS request_ts FROM r WINDOW o AS (PARTITION BY user_id ORDER BY ts, message_id))
        SELECT message_id, user_id, request_ts, ts - request_ts AS latency_us FROM w WHERE kind = 'RESP' AND before = 'REQ'""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").select("message_id", "user_id", "ts", "event_type")
    found = P.request_latency(messages, ["user_id"], ["ts", "message_id"], F.expr(_KIND))
    return found.select("message_id", "user_id", "request_ts", "latency_us")


_PAIRS = """WITH w AS (SELECT frame_number, session_id, hop_by_hop_id, interface, is_request, ts, lead(is_request) OVER o AS next_req,
    lead(ts) OVER o AS next_ts FROM diameter WINDOW o AS (PARTITION BY session_id, hop_by_hop_id ORDER BY ts, frame_number)),
  p AS (SELECT frame_number, session_id, interface, CASE WHEN NOT next_req THEN next_ts END AS answer_ts,
    CASE WHEN NOT next_req THEN next_ts - ts END AS latency_us FROM w WHERE is_request)"""


def _pairs(spark, sf):
    messages = bound(spark, sf, "diameter").select("frame_number", "session_id", "hop_by_hop_id", "interface", "is_request", "ts")
    return P.transactions(messages, ["session_id", "hop_by_hop_id"], ["ts", "frame_number"], F.col("is_request"))


@register(
    "diameter_pairs",
    check(_PAIRS + " SELECT frame_number, session_id, answer_ts, latency_us, answer_ts IS NOT NULL AS complete FROM p", "diameter"),
)
def _(spark, sf):
    return _pairs(spark, sf).select("frame_number", "session_id", "answer_ts", "latency_us", "complete")


@register(
    "diameter_session_latency",
    check(
        _PAIRS + """ SELECT session_id, count(*) AS requests, count(answer_ts) AS completed_pairs,
        round(avg(latency_us), 3) AS mean_latency_us FROM p GROUP BY session_id""",
        "diameter",
    ),
)
def _(spark, sf):
    return P.session_latency(_pairs(spark, sf), "session_id").withColumn("mean_latency_us", F.round("mean_latency_us", 3))


# Stack matching, written as the level rule over plain windows.
_STACK = """WITH s AS (SELECT *, sum(CASE kind WHEN 'REQ' THEN 1 ELSE -1 END) OVER (PARTITION BY teid ORDER BY ts, frame_number) AS s FROM echoes),
  f AS (SELECT *, least(min(s) OVER (PARTITION BY teid ORDER BY ts, frame_number), 0) AS m,
    coalesce(least(min(s) OVER (PARTITION BY teid ORDER BY ts, frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS m0 FROM s),
  l AS (SELECT *, CASE kind WHEN 'REQ' THEN s - m ELSE s + 1 - m END AS level FROM f WHERE kind = 'REQ' OR s >= m0),
  n AS (SELECT *, lead(kind) OVER o AS next_kind, lead(ts) OVER o AS next_ts FROM l WINDOW o AS (PARTITION BY teid, level ORDER BY ts, frame_number)),
  e AS (SELECT teid, ts, frame_number, CASE WHEN next_kind = 'RESP' THEN next_ts END AS response_ts FROM n WHERE kind = 'REQ'),
  g AS (SELECT *, (ts - lag(ts) OVER o) // 1000000 AS interval_sec, lead(ts) OVER o AS next_at FROM e
    WINDOW o AS (PARTITION BY teid ORDER BY ts, frame_number)),
  h AS (SELECT *, lag(interval_sec) OVER (PARTITION BY teid ORDER BY ts, frame_number) AS last_interval,
    coalesce(response_ts IS NULL AND (next_at - ts) // 1000000 > CASE WHEN interval_sec > 0 THEN interval_sec * 3 ELSE 900 END, false) AS timed_out FROM g),
  b AS (SELECT *, interval_sec IS NULL OR next_at IS NULL OR timed_out
    OR coalesce(last_interval > 0 AND abs(interval_sec - last_interval) > last_interval * 0.2, false) AS breaks FROM h),
  r AS (SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY teid ORDER BY ts, frame_number) AS run FROM b)"""


def _echoes(spark, sf):
    return K.echoes_with_flags(bound(spark, sf, "echoes"), ["teid"], ["ts", "frame_number"], F.col("kind"))


@register(
    "unanswered_echoes",
    check(_STACK + " SELECT frame_number, teid, response_ts FROM e", "echoes"),
)
def _(spark, sf):
    found = P.latest_unanswered(bound(spark, sf, "echoes"), ["teid"], ["ts", "frame_number"], F.col("kind"))
    return found.select("frame_number", "teid", "response_ts")


@register(
    "keepalive_runs",
    check(
        _STACK + """ SELECT teid, CAST(run AS BIGINT) AS run, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS echoes,
        CAST(sum(interval_sec) AS BIGINT) // count(*) AS avg_interval_sec, bool_and(response_ts IS NOT NULL) AS all_successful
        FROM r WHERE NOT breaks GROUP BY teid, run""",
        "echoes",
    ),
)
def _(spark, sf):
    return K.keepalive_runs(_echoes(spark, sf), ["teid"], ["ts", "frame_number"])


@register(
    "echo_statistics",
    check(
        _STACK + """ SELECT teid, count(*) AS requests, count(response_ts) AS responses, count(*) FILTER (timed_out) AS timeouts,
        max(ts) AS last_request_ts, max(response_ts) AS last_response_ts,
        coalesce(CAST(sum(interval_sec) AS BIGINT) // nullif(count(interval_sec), 0), 0) AS avg_interval_sec FROM b GROUP BY teid""",
        "echoes",
    ),
)
def _(spark, sf):
    return K.echo_statistics(_echoes(spark, sf), ["teid"], ["ts", "frame_number"])


@register(
    "near_duplicates",
    check(
        """SELECT message_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, message_id) <= 3600000000, false)
        AS is_duplicate FROM messages""",
        "messages",
    ),
)
def _(spark, sf):
    messages = bound(spark, sf, "messages").select("message_id", "user_id", "event_type", "ts")
    found = P.near_duplicates(messages, ["user_id", "event_type"], ["ts", "message_id"], within_us=3_600_000_000)
    return found.select("message_id", "is_duplicate")


@register(
    "payload_copies",
    """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents""",
)
def _(spark, sf):
    """Copies of a payload: same length and same checksum of the whole."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("t"), F.length("text").alias("n"), P.payload_checksum("text").alias("whole")
    )
    walked = P.carry_along(rows, ["n", "whole"], ["doc_id"], _before=P.previous(F.col("doc_id")))
    return walked.select("doc_id", F.col("_before").isNotNull().alias("is_duplicate"))


@register(
    "stream_accounting",
    check(
        """WITH q AS (SELECT src_ip, ts, packet_id, l_partkey, bytes, l_partkey AS seq FROM packets),
        w AS (SELECT *, max(seq + bytes) OVER (PARTITION BY src_ip ORDER BY ts, packet_id, l_partkey, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM q)
        SELECT src_ip, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes,
          CAST(sum(CASE WHEN high IS NULL THEN bytes ELSE greatest(0, seq + bytes - greatest(seq, high)) END) AS BIGINT) AS new_bytes,
          count(*) FILTER (seq + bytes <= high) AS retransmissions, count(*) FILTER (seq > high) AS gaps,
          CAST(sum(CASE WHEN seq > high THEN seq - high ELSE 0 END) AS BIGINT) AS gap_bytes FROM w GROUP BY src_ip""",
        "packets",
    ),
)
def _(spark, sf):
    packets = bound(spark, sf, "packets").select("src_ip", "ts", "packet_id", "l_partkey", "bytes")
    return P.stream_accounting(packets, ["src_ip"], ["ts", "packet_id", "l_partkey", "bytes"], "l_partkey", "bytes")


@register(
    "chunk_gaps",
    check(
        """WITH w AS (SELECT ssrc, sequence_number AS n, lag(sequence_number) OVER (PARTITION BY ssrc ORDER BY ts, frame_number) AS p FROM rtp)
        SELECT ssrc, count(*) AS chunks, count(*) FILTER (n <> p + 1) AS gaps FROM w GROUP BY ssrc""",
        "rtp",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "rtp").select("ssrc", "ts", "frame_number", "sequence_number")
    return P.chunk_gaps(rows, ["ssrc"], ["ts", "frame_number"], "sequence_number")


@register(
    "fragment_completeness",
    """WITH f AS (SELECT l_orderkey, (l_linenumber - 1) * 8 AS off, max(8 + l_partkey % 3) AS len, bool_and(l_linenumber <> 4) AS more
        FROM lineitem GROUP BY 1, 2),
      w AS (SELECT *, max(off + len) OVER (PARTITION BY l_orderkey ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
    SELECT l_orderkey, count(*) AS fragments, max(off + len) AS bytes,
      bool_and(coalesce(reach, 0) >= off) AND bool_or(NOT more) AND coalesce(max(CASE WHEN NOT more THEN off + len END) = max(off + len), false) AS complete
    FROM w GROUP BY l_orderkey""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "(l_linenumber - 1) * 8 AS off", "8 + l_partkey % 3 AS len", "l_linenumber <> 4 AS more"
    )
    return P.fragment_completeness(rows, ["l_orderkey"], "off", "len", "more")


_CHANGES = """WITH c AS (SELECT user_id, ts, message_id, k, src_ip, lag(k) OVER o AS old_k, lag(src_ip) OVER o AS old_src_ip FROM messages
    WINDOW o AS (PARTITION BY user_id ORDER BY ts, message_id)),
  h AS (SELECT * FROM c WHERE old_k IS NOT NULL AND k <> old_k)"""


def _changes(spark, sf):
    return H.key_changes(bound(spark, sf, "messages"), ["user_id"], ["ts", "message_id"], "k", ["src_ip"])


@register("handovers", check(_CHANGES + " SELECT * FROM h", "messages"))
def _(spark, sf):
    return _changes(spark, sf)


_INTERRUPTED = _CHANGES + """, i AS (SELECT h.user_id, h.ts, h.message_id, h.k, h.old_k,
    (h.ts - (SELECT max(m.ts) FROM messages m WHERE m.user_id = h.user_id AND m.k = h.old_k AND m.ts < h.ts)) // 1000 AS interruption_ms FROM h),
  q AS (SELECT *, CASE WHEN interruption_ms < 0 THEN 'INVALID' WHEN interruption_ms = 0 THEN 'SEAMLESS' WHEN interruption_ms < 50 THEN 'EXCELLENT'
    WHEN interruption_ms < 100 THEN 'GOOD' WHEN interruption_ms < 300 THEN 'ACCEPTABLE' WHEN interruption_ms < 1000 THEN 'POOR'
    WHEN interruption_ms IS NOT NULL THEN 'FAILED' END AS quality FROM i)"""


def _interrupted(spark, sf):
    messages = bound(spark, sf, "messages").select("user_id", "k", "ts", "message_id")
    changes = _changes(spark, sf).select("user_id", "ts", "message_id", "k", "old_k")
    return H.interruptions(changes, messages, ["user_id"], "k", "ts", "message_id")


@register("handover_interruptions", check(_INTERRUPTED + " SELECT * FROM q", "messages"))
def _(spark, sf):
    return _interrupted(spark, sf)


@register(
    "handover_statistics",
    check(
        _INTERRUPTED + """ SELECT count(*) AS total_handovers, count(*) FILTER (interruption_ms < 86400000) AS successful_handovers,
        count(*) - count(*) FILTER (interruption_ms < 86400000) AS failed_handovers,
        round(count(*) FILTER (interruption_ms < 86400000) * 100.0 / count(*), 6) AS success_rate_percent,
        round(avg(interruption_ms), 6) AS avg_interruption_ms, min(interruption_ms) AS min_interruption_ms, max(interruption_ms) AS max_interruption_ms FROM q""",
        "messages",
    ),
)
def _(spark, sf):
    rows = _interrupted(spark, sf).withColumn("success", F.coalesce(F.col("interruption_ms") < 86_400_000, F.lit(False)))
    rounded = {c: F.round(c, 6) for c in ("success_rate_percent", "avg_interruption_ms")}
    return H.handover_statistics(rows).withColumns(rounded)


@register(
    "handover_types",
    check(
        """SELECT message_id, CASE WHEN protocol = 'S1AP' AND message_type = 'S1AP_INITIAL_UE_MESSAGE' THEN 'UNKNOWN'
          WHEN stated <> '' THEN stated WHEN message_type = 'GTP_MODIFY_BEARER_RESP' THEN 'X2' ELSE 'UNKNOWN' END AS handover_type,
          CASE WHEN cause IS NOT NULL THEN cause = 16 ELSE message_type = 'GTP_MODIFY_BEARER_RESP' AND NOT has_error END AS success
        FROM (SELECT *, CASE WHEN k % 10 = 3 AND protocol <> 'S1AP' THEN 'N2' ELSE '' END AS stated,
          CASE WHEN k % 4 = 0 THEN k % 20 END AS cause, k % 3 = 0 AS has_error FROM messages)""",
        "messages",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "messages").selectExpr(
        "*", "CASE WHEN k % 10 = 3 AND protocol <> 'S1AP' THEN 'N2' ELSE '' END AS stated",
        "CASE WHEN k % 4 = 0 THEN k % 20 END AS cause", "k % 3 = 0 AS has_error",
    )
    return rows.select(
        "message_id",
        H.handover_type(F.col("protocol"), F.col("message_type"), F.col("stated")).alias("handover_type"),
        H.handover_succeeded(F.col("message_type"), F.col("cause"), F.col("has_error")).alias("success"),
    )


_HO = "CASE k % 4 WHEN 0 THEN 'S1AP_HANDOVER_REQUEST' WHEN 1 THEN 'S1AP_HANDOVER_REQUEST_ACK' WHEN 2 THEN 'NGAP_HANDOVER_REQUEST' ELSE 'OTHER' END"


@register(
    "handover_preparation",
    check(
        f"""SELECT user_id, coalesce((min(CASE WHEN h = 'S1AP_HANDOVER_REQUEST_ACK' THEN ts END)
          - min(CASE WHEN h IN ('S1AP_HANDOVER_REQUEST', 'NGAP_HANDOVER_REQUEST') THEN ts END)) // 1000, 0) AS preparation_ms
        FROM (SELECT *, {_HO} AS h FROM messages) GROUP BY user_id""",
        "messages",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "messages").withColumn("h", F.expr(_HO))
    return H.preparation_time(rows, ["user_id"], "ts", "h")


@register(
    "tunnel_volume",
    check(
        """SELECT teid, count(*) FILTER (d = 'UPLINK') AS packets_uplink, count(*) FILTER (d = 'DOWNLINK') AS packets_downlink,
        CAST(sum(CASE WHEN d = 'UPLINK' THEN bytes ELSE 0 END) AS BIGINT) AS bytes_uplink,
        CAST(sum(CASE WHEN d = 'DOWNLINK' THEN bytes ELSE 0 END) AS BIGINT) AS bytes_downlink
        FROM (SELECT *, CASE WHEN sequence % 2 = 0 THEN 'UPLINK' ELSE 'DOWNLINK' END AS d FROM gtp) GROUP BY teid""",
        "gtp",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "gtp").withColumn("d", F.expr("CASE WHEN sequence % 2 = 0 THEN 'UPLINK' ELSE 'DOWNLINK' END"))
    return H.volume_by_direction(rows, "teid", "d", "bytes")


@register(
    "tunnel_timeline",
    check(
        """SELECT teid AS entity, ts, 'created' AS event, CAST(frame_number AS VARCHAR) AS detail FROM gtp WHERE message_type = 32
        UNION ALL SELECT teid, ts, 'deleted', CAST(frame_number AS VARCHAR) FROM gtp WHERE message_type = 37
        UNION ALL SELECT teid, min(ts), 'echoes', CAST(count(*) AS VARCHAR) FROM echoes GROUP BY teid
        UNION ALL SELECT user_id, ts, 'handover', old_k || '>' || k FROM (SELECT user_id, ts, k,
          lag(k) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS old_k FROM messages) WHERE k <> old_k""",
        "gtp", "echoes", "messages",
    ),
)
def _(spark, sf):
    gtp = bound(spark, sf, "gtp").select(F.col("teid").alias("entity"), "ts", F.col("frame_number").alias("detail"), "message_type")
    echoes = bound(spark, sf, "echoes").groupBy(F.col("teid").alias("entity")).agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("detail")
    )
    changes = H.key_changes(bound(spark, sf, "messages"), ["user_id"], ["ts", "message_id"], "k")
    moved = changes.select(
        F.col("user_id").alias("entity"), "ts", F.concat_ws(">", F.col("old_k").cast("string"), F.col("k").cast("string")).alias("detail")
    )
    return H.tunnel_timeline(
        created=gtp.filter("message_type = 32"), deleted=gtp.filter("message_type = 37"), echoes=echoes, handover=moved
    )


@register(
    "tunnel_statistics",
    check(
        """WITH s AS (SELECT teid, max_by(message_type, (ts, frame_number)) FILTER (message_type IN (33, 37)) AS m,
          CAST(sum(CASE WHEN sequence % 2 = 0 THEN bytes ELSE 0 END) AS BIGINT) AS up,
          CAST(sum(CASE WHEN sequence % 2 = 1 THEN bytes ELSE 0 END) AS BIGINT) AS down, count(*) FILTER (message_type = 35) AS ho FROM gtp GROUP BY teid),
        e AS (SELECT teid, count(*) AS n FROM echoes GROUP BY teid)
        SELECT count(*) AS tunnels, count(*) FILTER (m = 33) AS active, count(*) FILTER (m = 37) AS deleted, CAST(sum(ho) AS BIGINT) AS handovers,
          CAST(sum(n) AS BIGINT) AS echoes, CAST(sum(up) AS BIGINT) AS bytes_uplink, CAST(sum(down) AS BIGINT) AS bytes_downlink FROM s JOIN e USING (teid)""",
        "gtp", "echoes",
    ),
)
def _(spark, sf):
    gtp = bound(spark, sf, "gtp").withColumn("d", F.expr("CASE WHEN sequence % 2 = 0 THEN 'UPLINK' ELSE 'DOWNLINK' END"))
    mark = F.expr("CASE message_type WHEN 33 THEN 'ACTIVE' WHEN 37 THEN 'DELETED' END")
    state = gtp.groupBy("teid").agg(
        F.max_by(mark, F.when(mark.isNotNull(), F.struct("ts", "frame_number"))).alias("state"),
        F.count_if(F.col("message_type") == 35).alias("handovers"),
    )
    echoes = bound(spark, sf, "echoes").groupBy("teid").agg(F.count(F.lit(1)).alias("echoes"))
    volume = H.volume_by_direction(gtp, "teid", "d", "bytes")
    return H.tunnel_statistics(state.join(echoes, "teid").join(volume, "teid"))
