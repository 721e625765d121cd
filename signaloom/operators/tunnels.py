"""GTP sessions, bearers and tunnel registry; S1AP and NAS contexts; charging usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import pdn_class
from .hubs import salted_join
from .sessions import first_known, last_seen_value
from .timeline import Slab, carry_along, last_known, running

# GTP message type codes.
CREATE_REQUEST, CREATE_RESPONSE, DELETE_REQUEST, DELETE_RESPONSE = 32, 33, 36, 37
SUCCESS_CAUSES = (16, 17)


def numbered_sessions(messages: DataFrame, order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Messages with the ``session_no`` within their control tunnel: every establishment opens a new one.

    Messages of a tunnel before any establishment form the session 0 of that tunnel.
    """
    opens = F.col("message_type") == CREATE_REQUEST
    return carry_along(messages, ["teid"], order, slab, session_no=running("sum", opens.cast("bigint")))


def gtp_sessions(messages: DataFrame, order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Sessions by control tunnel, numbered as :func:`numbered_sessions`.

    Needs teid, sequence, message_type, cause, imsi, msisdn, apn.
    """
    narrow = messages.select("teid", *order, "message_type", "cause", "imsi", "msisdn", "apn")
    return session_totals(numbered_sessions(narrow, order, slab), order)


def session_totals(numbered: DataFrame, order: Sequence[str], **also: Column) -> DataFrame:
    """One row per (``teid, session_no``): span, messages, identifiers, errors and state, and the aggregates ``also`` names."""
    deleted = (F.col("message_type") == DELETE_RESPONSE) & F.col("cause").isin(list(SUCCESS_CAUSES))
    created = (F.col("message_type") == CREATE_RESPONSE) & F.col("cause").isin(list(SUCCESS_CAUSES))
    failed = F.col("cause").isNotNull() & ~F.col("cause").isin(list(SUCCESS_CAUSES))
    rolled = numbered.groupBy("teid", "session_no").agg(
        F.min(order[0]).alias("start_ts"),
        F.max(order[0]).alias("end_ts"),
        F.count(F.lit(1)).alias("messages"),
        first_known("imsi", order).alias("imsi"),
        first_known("msisdn", order).alias("msisdn"),
        first_known("apn", order).alias("apn"),
        F.coalesce(F.bool_or(created), F.lit(False)).alias("_created"),
        F.coalesce(F.bool_or(deleted), F.lit(False)).alias("_deleted"),
        F.count_if(F.coalesce(failed, F.lit(False))).alias("errors"),
        *[value.alias(name) for name, value in also.items()],
    )
    state = F.when(F.col("_deleted"), "DELETED").when(F.col("_created"), "ACTIVE").otherwise("CREATING")
    return rolled.withColumn("pdn_class", pdn_class("apn")).withColumn("state", state).drop("_created", "_deleted")


def bearers(messages: DataFrame, session: Sequence[str], order: Sequence[str], bearer_list: str = "bearers") -> DataFrame:
    """Latest known values of every bearer of a session; active once a success cause was seen."""
    each = messages.select(*session, *order, "cause", F.explode(bearer_list).alias("b")).select(
        *session, *order, "cause", "b.*"
    )
    ok = F.col("cause").isin(list(SUCCESS_CAUSES))
    attributes = [c for c in each.columns if c not in (*session, *order, "cause", "ebi")]
    return each.groupBy(*session, "ebi").agg(
        *[last_seen_value(a, order).alias(a) for a in attributes],
        F.coalesce(F.bool_or(ok), F.lit(False)).alias("active"),
    )


def bearer_statistics(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("bearers"),
        F.count_if("is_default").alias("default_bearers"),
        F.count_if(~F.col("is_default")).alias("dedicated_bearers"),
        F.count_if("active").alias("active_bearers"),
    )


TEID_ROLES = ("teid_uplink", "teid_downlink", "teid_s5_sgw", "teid_s5_pgw")


def tunnel_registry(registrations: DataFrame, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Latest registration known under each tunnel id, over all four roles; ``primary_teid`` = uplink else downlink."""
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    named = registrations.withColumn("primary_teid", F.coalesce(known(TEID_ROLES[0]), known(TEID_ROLES[1])))
    ids = F.array_distinct(F.array_compact(F.array(*[known(c) for c in TEID_ROLES])))
    each = named.filter("primary_teid is not null").select(*order, "primary_teid", *carried, F.explode(ids).alias("teid"))
    row = F.struct("primary_teid", *carried, F.col(order[0]).alias("registered_ts"))
    latest = each.groupBy("teid").agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return latest.select("teid", "_row.*")


def still_registered(registry: DataFrame, deletes: DataFrame, ts: str) -> DataFrame:
    """Registrations that no later delete of their primary tunnel removed."""
    gone = deletes.groupBy("primary_teid").agg(F.max(ts).alias("_deleted"))
    joined = salted_join(registry, gone, ["primary_teid"], "left")
    return joined.filter(F.col("_deleted").isNull() | (F.col("_deleted") < F.col("registered_ts"))).drop("_deleted")


def latest_tunnel_by(registry: DataFrame, key: str) -> DataFrame:
    """Latest primary tunnel per subscriber, address or session."""
    return registry.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by("primary_teid", F.struct("registered_ts", "primary_teid")).alias("primary_teid")
    )


def packet_owner(packets: DataFrame, endpoints: DataFrame, carried: Sequence[str]) -> DataFrame:
    """User-plane packets with the session of (dst_ip, teid), else of (src_ip, teid).

    ``endpoints`` has one row per (ip, teid). Salted equi-joins; Spark broadcasts the endpoint table by itself when
    its measured size allows.
    """
    found = packets
    for side in ("dst", "src"):
        ends = endpoints.select(
            F.col("ip").alias(f"{side}_ip"), "teid", F.struct(*carried).alias(f"_{side}_owner")
        )
        found = salted_join(found, ends, [f"{side}_ip", "teid"], "left")
    owner = F.coalesce("_dst_owner", "_src_owner")
    return found.select(*packets.columns, *[owner[c].alias(c) for c in carried])


def s1ap_contexts(messages: DataFrame, order: Sequence[str], slab: Slab = None) -> DataFrame:
    """UE contexts: an initial message knows only the eNB id; the pair that follows adopts it.

    Contexts are islands of an eNB id that begin at each initial message.
    """
    initial = F.col("message_type") == "INITIAL_UE_MESSAGE"
    narrow = messages.select("enb_ue_id", *order, "message_type", "mme_ue_id")
    islands = carry_along(narrow, ["enb_ue_id"], order, slab, context_no=running("sum", initial.cast("bigint")))
    place = F.struct(*order)
    state = (
        F.when(initial, "INITIAL")
        .when(F.col("message_type") == "INITIAL_CONTEXT_SETUP_REQUEST", "CONTEXT_SETUP")
        .when(F.col("message_type") == "INITIAL_CONTEXT_SETUP_RESPONSE", "ACTIVE")
        .when(F.col("message_type") == "UE_CONTEXT_RELEASE_COMMAND", "RELEASING")
        .when(F.col("message_type") == "UE_CONTEXT_RELEASE_COMPLETE", "RELEASED")
    )
    return islands.groupBy("enb_ue_id", "context_no").agg(
        first_known("mme_ue_id", order).alias("mme_ue_id"),
        F.min(order[0]).alias("start_ts"),
        F.max(order[0]).alias("end_ts"),
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("message_type").isin("HANDOVER_NOTIFY", "PATH_SWITCH_REQUEST")).alias("handovers"),
        F.max_by(state, F.when(state.isNotNull(), place)).alias("state"),
    )


def context_statistics(contexts: DataFrame) -> DataFrame:
    return contexts.agg(
        F.count(F.lit(1)).alias("contexts"),
        F.count_if(F.col("state").isin("ACTIVE", "CONTEXT_SETUP")).alias("active"),
        F.count_if(F.col("state") == "RELEASED").alias("released"),
        F.sum("handovers").alias("handovers"),
    )


# NAS mobility state set by a message.
EMM_STATES = {
    "ATTACH_REQUEST": "REGISTERED_INITIATED", "ATTACH_ACCEPT": "REGISTERED", "TAU_ACCEPT": "REGISTERED",
    "DETACH_REQUEST": "DEREGISTERED_INITIATED", "DETACH_ACCEPT": "DEREGISTERED", "TAU_REQUEST": "TAU_INITIATED",
    "SERVICE_REQUEST": "SERVICE_REQUEST_INITIATED", "EXTENDED_SERVICE_REQUEST": "SERVICE_REQUEST_INITIATED",
}


def nas_sessions(messages: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """NAS sessions (ids from key merging): kind, mobility state, IMS flag, attach / update / detach counts."""
    place, kind = F.struct(*order), F.col("message_type")
    state = F.create_map(*[F.lit(x) for pair in EMM_STATES.items() for x in pair])[kind]
    return messages.groupBy(session).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("kind") == "EMM").alias("emm_messages"),
        F.count_if(F.col("kind") == "ESM").alias("esm_messages"),
        F.coalesce(F.bool_or((F.col("kind") == "ESM") & F.lower("apn").contains("ims")), F.lit(False)).alias("is_ims"),
        F.count_if(kind == "ATTACH_REQUEST").alias("attaches"),
        F.count_if(kind == "TAU_REQUEST").alias("tracking_updates"),
        F.count_if(kind == "DETACH_REQUEST").alias("detaches"),
        F.max_by(state, F.when(state.isNotNull(), place)).alias("emm_state"),
        first_known("imsi", order).alias("imsi"),
    )


# Reason code of a used-up quota.
QUOTA_EXHAUSTED = 3

WAYS = ("granted", "requested", "used")
UNITS = ("time", "total_octets", "input_octets", "output_octets")


def charging_usage(messages: DataFrame, by: Sequence[str], order: Sequence[str], controls: str = "mscc") -> DataFrame:
    """Granted, requested and used units per subscriber, rating group and service, and what came last.

    One message may control several services, so its list is exploded before grouping.
    """
    each = messages.select(*by, *order, F.explode(controls).alias("c")).select(*by, *order, "c.*")
    return each.groupBy(*by, "rating_group", "service_identifier").agg(
        F.count(F.lit(1)).alias("reports"),
        *[F.sum(f"{way}_{unit}").alias(f"{way}_{unit}") for way in WAYS for unit in UNITS],
        F.max_by("result_code", F.struct(*order)).alias("last_result_code"),
        F.coalesce(F.bool_or(F.col("reporting_reason") == QUOTA_EXHAUSTED), F.lit(False)).alias("quota_exhausted"),
        F.bool_or(F.col("final_unit_action").isNotNull()).alias("final_unit"),
        F.max_by("final_unit_action", F.when(F.col("final_unit_action").isNotNull(), F.struct(*order))).alias("final_unit_action"),
    )


def follow_tunnel(messages: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, slab: Slab = None):
    """Forward-fill a tunnel's identifier from its establishment onto later messages."""
    return carry_along(messages, by, order, slab, **{name: last_known(value, inclusive=True)})
