"""Roll-ups of messages into sessions, legs, flows and subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import SESSION_ENDS, SESSION_STARTS, session_type
from ..functions.core import axis, millis
from .asof import first_by_precedence
from .hubs import salted_join
from .timeline import Slab


def first_known(value: str, order: Sequence[str]) -> Column:
    """First non-NULL ``value`` in time order."""
    known = F.col(value).isNotNull()
    return F.min_by(F.col(value), F.when(known, F.struct(*order)))


def last_seen_value(value: str, order: Sequence[str]) -> Column:
    known = F.col(value).isNotNull()
    return F.max_by(F.col(value), F.when(known, F.struct(*order)))


def text_set(value: str | Column) -> Column:
    """Sorted, comma-separated distinct values; for columns with a small fixed range of values only."""
    return F.array_join(F.array_sort(F.collect_set(value)), ",")


def session_rollup(
    messages: DataFrame,
    session: str,
    order: Sequence[str],
    length: str,
    keys: Sequence[str] = (),
    interface: str = "interface",
    protocol: str = "protocol",
) -> DataFrame:
    """Span, volume, interfaces, protocols, type and first known keys of every session.

    Every aggregate here is combined map-side; the only collected sets are interfaces and protocols, which have
    a fixed small range. Participants are a table of their own, see :func:`participants`.
    """
    ts = order[0]
    span = F.max(axis(messages, ts)) - F.min(axis(messages, ts))
    rolled = messages.groupBy(session).agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        millis(span).alias("duration_ms"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(length).alias("bytes"),
        F.array_sort(F.collect_set(interface)).alias("_interfaces"),
        text_set(protocol).alias("protocols"),
        *[first_known(k, order).alias(k) for k in keys],
    )
    legs = F.size("_interfaces")
    return (
        rolled.withColumn("legs", legs)
        .withColumn("session_type", session_type("_interfaces", "legs"))
        .withColumn("interfaces", F.array_join("_interfaces", ","))
        .withColumn("is_complete", (F.col("legs") > 0) & (F.col("end_ts") > F.col("start_ts")))
        .drop("_interfaces")
    )


def primary_identifier(keys: Sequence[str]) -> Column:
    """The first of ``keys`` that a session has, as text; ``unknown`` where it has none."""
    return F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("unknown"))


def participants(messages: DataFrame, session: str, endpoints: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct (session, ``participant``) with ``ip:port`` texts."""
    sides = F.array(*[F.concat_ws(":", F.col(ip), F.col(port).cast("string")) for ip, port in endpoints])
    return messages.select(session, F.explode(sides).alias("participant")).distinct()


def session_markers(messages: DataFrame, session: str, kind: str) -> DataFrame:
    """Whether a session holds a start and an end message."""
    return messages.groupBy(session).agg(
        F.bool_or(F.col(kind).isin(list(SESSION_STARTS))).alias("has_start"),
        F.bool_or(F.col(kind).isin(list(SESSION_ENDS))).alias("has_end"),
    )


def leg_rollup(messages: DataFrame, session: str, interface: str, ts: str, length: str) -> DataFrame:
    return messages.groupBy(session, interface).agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("messages"),
        F.sum(length).alias("bytes"),
    )


def setup_time(messages: DataFrame, session: str, ts: str, started: Column, answered: Column) -> DataFrame:
    """Milliseconds from a session's first start message to the first answer at or after it."""
    at = axis(messages, ts)
    begin = messages.groupBy(session).agg(F.min(F.when(started, at)).alias("_begin"))
    answers = messages.filter(answered).select(session, at.alias("_at"))
    after = salted_join(answers, begin, [session]).filter("_at >= _begin")
    return after.groupBy(session).agg(millis(F.min(F.col("_at") - F.col("_begin"))).alias("setup_time_ms"))


def correlation_statistics(sessions: DataFrame, setup: str | None = None) -> DataFrame:
    """Totals and averages over session roll-ups."""
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.sum("packets"), F.lit(0)).alias("total_messages"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        (F.avg(setup) if setup else F.lit(None).cast("double")).alias("avg_setup_time_ms"),
    )


def count_map(rows: DataFrame, value: str, name: str) -> DataFrame:
    """One row with MAP<value, count>; for values of a small fixed range."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(value, "_n"))).alias(name))


def subscriber_messages(messages: DataFrame, message_id: str, order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Messages that belong to a subscriber, with that subscriber's ``imsi``.

    A call-signalling message belongs to its own imsi, else to the subscriber that last claimed (create-session
    message with imsi and address) its address v4, v6, then the packet's source and destination address.
    """
    at = axis(messages, order[0])
    claim = (F.col("message_type") == "GTP_CREATE_SESSION_REQ") & F.col("imsi").isNotNull()
    claims = (
        messages.filter(claim)
        .select("imsi", at.alias("_claim_at"), F.col(message_id).alias("_claim_id"),
                F.explode(F.array("ue_ipv4", "ue_ipv6")).alias("ip"))
        .filter("ip is not null")
    )
    signalling = messages.filter((F.col("protocol") == "SIP") & F.col("imsi").isNull())
    found = first_by_precedence(
        signalling, claims, message_id, [F.col("ue_ipv4"), F.col("ue_ipv6"), F.col("src_ip"), F.col("dst_ip")],
        at, "ip", F.col("_claim_at"), "_claim_id", "imsi", slab,
    ).withColumnRenamed("imsi", "_found")
    takes_part = F.col("protocol").isin("SIP", "DIAMETER") | claim
    return (
        messages.filter(takes_part)
        .join(found, message_id, "left")
        .withColumn("imsi", F.coalesce("imsi", "_found"))
        .filter("imsi is not null")
        .drop("_found")
    )


def master_sessions(
    messages: DataFrame,
    session: str,
    message_id: str,
    order: Sequence[str],
    slab: Slab = None,
) -> DataFrame:
    """One row per subscriber of :func:`subscriber_messages`: span, last tunnel session, numbers of call and charging
    sessions, phone number."""
    owned = subscriber_messages(messages, message_id, order, slab)
    of_gtp, of_sip, of_diameter = (
        F.when(F.col("protocol") == p, F.col(session)) for p in ("GTP_C", "SIP", "DIAMETER")
    )
    return owned.groupBy("imsi").agg(
        F.min(order[0]).alias("start_ts"),
        F.max(order[0]).alias("last_update_ts"),
        F.max_by(of_gtp, F.when(of_gtp.isNotNull(), F.struct(*order))).alias("gtp_session"),
        F.count_distinct(of_sip).alias("sip_sessions"),
        F.count_distinct(of_diameter).alias("diameter_sessions"),
        last_seen_value("msisdn", order).alias("msisdn"),
        F.count(F.lit(1)).alias("events"),
    )


def master_session_links(owned: DataFrame, master: str, session: str, protocol: str) -> DataFrame:
    """Child table of a master session: its distinct (protocol, session) links."""
    return owned.select(master, protocol, session).distinct()


FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "transport")


def flow_table(packets: DataFrame, order: Sequence[str], length: str, protocol: str, by: Sequence[str] = FIVE_TUPLE):
    """Directional flows: span, packets, bytes and first known protocol per 5-tuple."""
    ts = order[0]
    return packets.groupBy(*by).agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(length).alias("bytes"),
        F.min_by(protocol, F.when(F.col(protocol) != "UNKNOWN", F.struct(*order))).alias("protocol"),
    )


def protocol_session_key(
    protocol: str, call_id: str, diameter_session: str, teid: str, seid: str, stream_id: str, flow: Column, f_seid: str | None = None
) -> Column:
    """Session key by protocol: call id, session id, tunnel or PFCP endpoint, HTTP/2 stream, else the flow itself.

    A PFCP message goes by the full endpoint id it carries (``f_seid``), else by the one in its header."""
    kind = F.col(protocol)
    text = lambda prefix, value: F.concat(F.lit(prefix), F.col(value).cast("string"))
    endpoints = [text("PFCP-", c) for c in (f_seid, seid) if c is not None]
    return F.coalesce(
        F.when(kind == "SIP", F.col(call_id)),
        F.when(kind == "DIAMETER", F.col(diameter_session)),
        F.when(kind == "GTP_C", text("GTP-", teid)),
        F.when(kind == "PFCP", F.coalesce(*endpoints, F.concat(F.lit("PFCP-"), flow))),
        F.when(kind == "HTTP2", F.concat(F.lit("HTTP2-"), flow, F.lit("-"), F.col(stream_id).cast("string"))),
        F.concat(F.lit("FLOW-"), flow),
    )


def keyed_flow_rollup(packets: DataFrame, key: str, ts: str, length: str) -> DataFrame:
    at = axis(packets, ts)
    return packets.groupBy(key).agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(length).alias("bytes"),
        millis(F.max(at) - F.min(at)).alias("duration_ms"),
    )


def diameter_session_key() -> Column:
    """The session id; messages without one form one session per hop-by-hop id."""
    synthetic = F.concat(F.lit("hop-"), F.col("hop_by_hop_id").cast("string"))
    return F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), synthetic)


def charging_rules(messages: DataFrame, rules: str) -> DataFrame:
    """Child table of the Diameter sessions: (``session_key, charging_rule``), each installed rule once."""
    named = messages.select(diameter_session_key().alias("session_key"), F.explode(rules).alias("charging_rule"))
    return named.distinct()


def diameter_rollup(messages: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Diameter sessions by :func:`diameter_session_key`, with the first known value of each of ``keys``."""
    named = messages.withColumn("session_key", diameter_session_key())
    error = F.coalesce((~F.col("is_request")) & (~F.col("result_code").between(2000, 2999)), F.lit(False))
    ts = order[0]
    return named.groupBy("session_key").agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("messages"),
        F.min_by("interface", F.struct(*order)).alias("interface"),
        text_set("result_code").alias("result_codes"),
        F.bool_or(error).alias("has_errors"),
        *[first_known(k, order).alias(k) for k in keys],
    )


def diameter_statistics(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests, answers, errors and answered requests per interface."""
    counts = messages.groupBy("interface").agg(
        F.count_if("is_request").alias("requests"),
        F.count_if(~F.col("is_request")).alias("answers"),
        F.count_if((~F.col("is_request")) & (~F.col("result_code").between(2000, 2999))).alias("errors"),
        F.count_distinct("session_id").alias("sessions"),
    )
    linked = pairs.groupBy("interface").agg(F.count_if("complete").alias("linked_pairs"))
    return counts.join(linked, "interface", "left").na.fill(0, ["linked_pairs"])


def not_seen_since(subscribers: DataFrame, last_seen: str, cutoff: Column) -> DataFrame:
    """Stale rows: last activity before ``cutoff``."""
    return subscribers.filter(F.col(last_seen) < cutoff)
