"""Participants and rows of message sequence diagrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import diagram_interface
from .hubs import salted_join
from .timeline import Slab, carry_along, fit_slab, row_number

# Fixed values: (source role, destination role) by protocol or port, by message type, by Diameter application.
PROTOCOL_ROLES = {
    ("S1AP", 36412): ("ENODEB", "MME"), ("NGAP", 38412): ("GNODEB", "AMF"), ("PFCP", 8805): ("SMF", "UPF"),
}
MESSAGE_ROLES = {
    "S1AP_INITIAL_UE_MESSAGE": ("ENODEB", "MME"), "NGAP_INITIAL_UE_MESSAGE": ("GNODEB", "AMF"),
    "GTP_CREATE_SESSION_REQ": ("MME", "SGW"), "GTP_CREATE_SESSION_RESP": ("SGW", "MME"),
    "PFCP_SESSION_ESTABLISHMENT_REQ": ("SMF", "UPF"), "SIP_REGISTER": ("UE", "P-CSCF"),
}
APPLICATION_ROLES = {
    16777251: ("MME", "HSS"), 16777238: ("PGW", "PCRF"), 16777236: ("P-CSCF", "PCRF"), 16777217: ("AS", "HSS"),
}
UNKNOWN = "UNKNOWN"
# Ports of SIP proxies; what a call shows, as (time, sender, receiver, protocol, message); the names of its participants.
SIP_PROXY_PORTS = (5060, 5061)
CALL_STEPS = (
    ("invite_ts", "ue", "pcscf", "SIP", "INVITE"), ("trying_ts", "pcscf", "ue", "SIP", "100 Trying"),
    ("rx_request_ts", "pcscf", "pcrf", "DIAMETER Rx", "AAR"), ("rx_answer_ts", "pcrf", "pcscf", "DIAMETER Rx", "AAA"),
    ("gx_request_ts", "pcrf", "pgw", "DIAMETER Gx", "RAR"), ("gx_answer_ts", "pgw", "pcrf", "DIAMETER Gx", "RAA"),
    ("bearer_request_ts", "pgw", "sgw", "GTP-C", "Create Bearer Request"), ("bearer_response_ts", "sgw", "pgw", "GTP-C", "Create Bearer Response"),
    ("ringing_ts", "pcscf", "ue", "SIP", "180 Ringing"), ("answer_ts", "pcscf", "ue", "SIP", "200 OK"), ("ack_ts", "ue", "pcscf", "SIP", "ACK"),
    ("media_ts", "ue", "remote", "RTP", "Media Start"), ("bye_ts", "ue", "pcscf", "SIP", "BYE"),
)
CALL_PARTICIPANTS = {"ue": "UE", "pcscf": "P-CSCF", "pcrf": "PCRF", "pgw": "PGW", "sgw": "SGW", "remote": "Remote Party"}


def endpoint_role(side: int, port: Column) -> Column:
    """Role of one endpoint (0 source, 1 destination) as this message shows it."""
    role = F.when(F.lit(False), "")
    for (protocol, known_port), roles in PROTOCOL_ROLES.items():
        fits = (F.col("protocol") == protocol) | ((port == known_port) & (F.col("protocol") != "HTTP2"))
        role = role.when(fits, roles[side])
    # HTTP/2 alone does not tell a role, but its message type may.
    for kind, roles in MESSAGE_ROLES.items():
        role = role.when(F.col("message_type") == kind, roles[side])
    for application, roles in APPLICATION_ROLES.items():
        role = role.when((F.col("protocol") == "DIAMETER") & (F.col("application_id") == application), roles[side])
    return role.otherwise(UNKNOWN)


def participants(
    messages: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    mapping: DataFrame | None = None,
    slab: Slab = None,
) -> DataFrame:
    """(by, ``ip``, ``role``, ``participant``): the first message that shows an address settles its role.

    ``mapping`` (ip, role and, if wanted, port) overrides: a row with the port that the address was first seen with,
    else any row of the address (one without a port, then the lowest port). Equal rows of a mapping that name several
    roles settle on the lowest. Ids are the role, with a number from the second one on in order of first
    appearance; a user is always ``UE``; an address of unknown role is named by itself.
    """
    sides = F.array(
        *[
            F.struct(
                F.col(f"{end}_ip").alias("ip"),
                F.col(f"{end}_port").alias("port"),
                endpoint_role(side, F.col(f"{end}_port")).alias("role"),
                F.lit(side).alias("side"),
            )
            for side, end in enumerate(("src", "dst"))
        ]
    )
    shown = messages.select(*by, *order, F.inline(sides)).filter("ip is not null")
    slab = fit_slab(messages, by, order[0]) if slab is None else slab
    place = F.struct(*order, "side")
    first = shown.groupBy(*by, "ip").agg(
        F.min_by(F.struct("role", "port"), place).alias("_seen"), F.min(place).alias("_place")
    )
    roles = first.select(*by, "ip", "_seen.role", "_seen.port", "_place.*")
    if mapping is not None:
        port = F.col("port") if "port" in mapping.columns else F.lit(None).cast("int")
        stated = mapping.select("ip", port.alias("port"), F.col("role").alias("_stated"))
        by_port = stated.dropna(subset=["port"]).groupBy("ip", "port").agg(F.min("_stated").alias("_at_port"))
        # a NULL port sorts first
        by_ip = stated.groupBy("ip").agg(F.min(F.struct("port", "_stated"))["_stated"].alias("_at_ip"))
        roles = salted_join(salted_join(roles, by_port, ["ip", "port"], "left"), by_ip, ["ip"], "left")
        roles = roles.withColumn("role", F.coalesce("_at_port", "_at_ip", "role")).drop("_at_port", "_at_ip")
    numbered = carry_along(roles, [*by, "role"], [*order, "side", "ip"], slab, nth=row_number())
    name = (
        F.when(F.col("role") == UNKNOWN, F.concat_ws(":", F.concat(F.lit("UNKNOWN-"), "ip"), F.when(F.col("port") != 0, F.col("port").cast("string"))))
        .when((F.col("role") == "UE") | (F.col("nth") == 1), F.col("role"))
        .otherwise(F.concat_ws("-", "role", F.when(F.col("nth") < 10, F.concat(F.lit("0"), F.col("nth").cast("string"))).otherwise(F.col("nth").cast("string"))))
    )
    return numbered.select(*by, "ip", "role", name.alias("participant"))


def diagram_rows(
    messages: DataFrame, people: DataFrame, by: Sequence[str], order: Sequence[str], slab: Slab = None
) -> DataFrame:
    """Numbered events with their sender, receiver and interface label.

    ``people`` has one row per address, so each of the two joins is against a per-key table and salts hub addresses.
    Events without a key or a time have no number.
    """
    slab = fit_slab(messages, by, order[0]) if slab is None else slab
    rows = messages
    for end in ("src", "dst"):
        ends = people.select(
            *by, F.col("ip").alias(f"{end}_ip"),
            F.col("participant").alias(f"_{end}_name"), F.col("role").alias(f"_{end}_role"),
        )
        rows = salted_join(rows, ends, [*by, f"{end}_ip"], "left")
    labelled = rows.withColumn("label", diagram_interface("protocol", "_src_role", "_dst_role", "application_id"))
    numbered = carry_along(labelled, by, order, slab, keep_unplaced=True, event_no=row_number())
    return numbered.select(
        *by, *order, "event_no", F.col("_src_name").alias("sender"), F.col("_dst_name").alias("receiver"), "message_type", "label"
    )


def lanes(rows: DataFrame, by: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Timeline lanes: events, first and last time per interface label."""
    return rows.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("events"), F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts")
    )


def sip_participants(messages: DataFrame, by: Sequence[str], slab: Slab = None) -> DataFrame:
    """(by, ``ip``, ``port``, ``participant``, ``label``, ``kind``): the ends of a session that has SIP only.

    Every address and port is a participant of its own; they are numbered from ``p0`` in order of address and port. The walk
    runs along the first bytes of the address, so a session of very many ends is cut like any other.
    """
    ends = F.array(*[F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").cast("int").alias("port")) for e in ("src", "dst")])
    each = messages.select(*by, F.inline(ends)).filter("ip is not null and port is not null").distinct()
    first_bytes = F.conv(F.hex(F.substring(F.encode(F.rpad("ip", 7, " "), "UTF-8"), 1, 7)), 16, 10).cast("bigint")
    numbered = carry_along(each.withColumn("_place", first_bytes), by, ["_place", "ip", "port"], slab, nth=row_number())
    proxy = F.col("port").isin(*SIP_PROXY_PORTS)
    return numbered.select(
        *by, "ip", "port", F.concat(F.lit("p"), (F.col("nth") - 1).cast("string")).alias("participant"),
        F.concat(F.when(proxy, "SIP-").otherwise("UE-"), F.substring_index("ip", ".", -1)).alias("label"),
        F.when(proxy, "proxy").otherwise("endpoint").alias("kind"),
    )


def sip_rows(messages: DataFrame, people: DataFrame, by: Sequence[str], order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Messages of SIP sessions, numbered from 0, between the participants of :func:`sip_participants`.

    ``messages`` has ``method``, ``status_code`` and, if known, ``reason``. A message is named by its method, an answer by its
    code and reason, anything else by ``SIP``. An end without address or port stays null; a message without a key or a time has no number.
    """
    slab = fit_slab(messages, by, order[0]) if slab is None else slab
    rows = messages if "reason" in messages.columns else messages.withColumn("reason", F.lit(None).cast("string"))
    rows = rows.select(*by, *order, *[f"{e}_{c}" for e in ("src", "dst") for c in ("ip", "port")], "method", "status_code", "reason")
    for end, name in (("src", "sender"), ("dst", "receiver")):
        ends = people.select(*by, F.col("ip").alias(f"{end}_ip"), F.col("port").alias(f"{end}_port"), F.col("participant").alias(name))
        rows = salted_join(rows, ends, [*by, f"{end}_ip", f"{end}_port"], "left")
    code = F.col("status_code").cast("string")
    label = F.coalesce("method", F.concat_ws(" ", code, F.when(code.isNotNull(), F.col("reason"))))
    numbered = carry_along(rows, by, order, slab, keep_unplaced=True, message_no=row_number())
    return numbered.select(
        *by, *order, (F.col("message_no") - 1).alias("message_no"), "sender", "receiver",
        F.coalesce("method", code, F.lit("")).alias("message"), F.when(label == "", "SIP").otherwise(label).alias("label"),
    )


def call_participants(calls: DataFrame, call: str, number: str) -> DataFrame:
    """(call, ``participant``, ``name``): the fixed cast of a call's own diagram; the user's name has the number."""
    user = F.concat(F.lit("UE ("), F.coalesce(F.col(number), F.lit("")), F.lit(")"))
    cast = [F.struct(F.lit(k).alias("participant"), (user if k == "ue" else F.lit(v)).alias("name")) for k, v in CALL_PARTICIPANTS.items()]
    return calls.select(call, F.inline(F.array(*cast)))


def call_rows(calls: DataFrame, call: str) -> DataFrame:
    """The diagram of each call from its known times (:data:`CALL_STEPS`; columns that are missing or null show nothing).

    ``event_no`` counts from 1 by time; steps at one time keep the order of the table. ``<time>_details``, such as
    ``bearer_request_details``, gives a step its text, else it is empty. One row per call in, no shuffle.
    """
    steps = []
    for place, (time, sender, receiver, protocol, message) in enumerate(CALL_STEPS):
        if time not in calls.columns:
            continue
        details = time.removesuffix("_ts") + "_details"
        text = F.coalesce(F.col(details).cast("string"), F.lit("")) if details in calls.columns else F.lit("")
        values = (sender, receiver, protocol, message)
        named = [F.lit(v).alias(n) for v, n in zip(values, ("sender", "receiver", "protocol", "message"), strict=True)]
        steps.append(F.when(F.col(time).isNotNull(), F.struct(F.col(time).alias("ts"), F.lit(place).alias("place"), *named, text.alias("details"))))
    if not steps:
        raise ValueError("none of the times of a call is given")
    shown = calls.select(call, F.posexplode(F.array_sort(F.array_compact(F.array(*steps)))).alias("pos", "s"))
    return shown.select(call, (F.col("pos") + 1).cast("bigint").alias("event_no"), *[f"s.{c}" for c in ("ts", "sender", "receiver", "protocol", "message", "details")])
