"""Protocol code tables and the classifications built on them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnLike, col

# Message type by (protocol, request flag, method / status / command / type code).
SIP_METHODS = {
    "INVITE": "SIP_INVITE", "ACK": "SIP_ACK", "BYE": "SIP_BYE", "CANCEL": "SIP_CANCEL",
    "REGISTER": "SIP_REGISTER", "OPTIONS": "SIP_OPTIONS", "PRACK": "SIP_PRACK", "UPDATE": "SIP_UPDATE",
}
SIP_STATUS = {100: "SIP_TRYING", 180: "SIP_RINGING", 200: "SIP_OK"}
DIAMETER_REQUESTS = {272: "DIAMETER_CCR", 265: "DIAMETER_AAR"}
DIAMETER_ANSWERS = {272: "DIAMETER_CCA", 265: "DIAMETER_AAA"}
GTP_TYPES = {
    1: "GTP_ECHO_REQ", 2: "GTP_ECHO_RESP", 32: "GTP_CREATE_SESSION_REQ", 33: "GTP_CREATE_SESSION_RESP",
    36: "GTP_DELETE_SESSION_REQ", 37: "GTP_DELETE_SESSION_RESP",
}
PFCP_TYPES = {
    50: "PFCP_SESSION_ESTABLISHMENT_REQ", 51: "PFCP_SESSION_ESTABLISHMENT_RESP",
    52: "PFCP_SESSION_MODIFICATION_REQ", 53: "PFCP_SESSION_MODIFICATION_RESP",
    54: "PFCP_SESSION_DELETION_REQ", 55: "PFCP_SESSION_DELETION_RESP",
}
# Well-known ports.
SCTP_PORTS = {36412: "S1-MME", 38412: "N2", 36422: "X2", 3868: "Diameter"}
UDP_PORTS = {2123: "S11", 2152: "S1-U", 8805: "N4", 5060: "IMS-SIP"}
TCP_PORTS = {3868: "Diameter", 5060: "IMS-SIP"}
WEB_PORTS = (80, 443)
MEDIA_PORTS = (10000, 64999)
# Diameter application id -> interface.
DIAMETER_APPLICATIONS = {
    16777251: "S6a", 16777238: "Gx", 16777236: "Rx", 16777217: "Sh", 16777250: "S6d", 16777252: "S13",
    16777272: "Sy",
}
# First path segment prefix -> network function.
SERVICE_PREFIXES = {
    "namf": "AMF", "nudm": "UDM", "nsmf": "SMF", "nausf": "AUSF", "nnrf": "NRF", "nnef": "NEF", "npcf": "PCF",
    "nupf": "UPF", "nslcef": "SLC",
}
# Request that a response message answers.
REQUEST_OF = {
    "GTP_CREATE_SESSION_RESP": "GTP_CREATE_SESSION_REQ", "GTP_MODIFY_BEARER_RESP": "GTP_MODIFY_BEARER_REQ",
    "GTP_DELETE_SESSION_RESP": "GTP_DELETE_SESSION_REQ", "GTP_ECHO_RESP": "GTP_ECHO_REQ",
    "PFCP_HEARTBEAT_RESP": "PFCP_HEARTBEAT_REQ",
    "PFCP_SESSION_ESTABLISHMENT_RESP": "PFCP_SESSION_ESTABLISHMENT_REQ",
    "DIAMETER_CCA": "DIAMETER_CCR", "DIAMETER_AAA": "DIAMETER_AAR",
    "SIP_TRYING": "SIP_INVITE", "SIP_RINGING": "SIP_INVITE",
}
# Messages that open and close a session.
SESSION_STARTS = (
    "SIP_INVITE", "NGAP_INITIAL_UE_MESSAGE", "NAS5G_REGISTRATION_REQUEST",
    "NAS5G_PDU_SESSION_ESTABLISHMENT_REQUEST", "X2AP_HANDOVER_PREPARATION", "NGAP_PDU_SESSION_RESOURCE_SETUP_REQ",
)
SESSION_ENDS = (
    "SIP_BYE", "NAS5G_DEREGISTRATION_REQUEST", "NGAP_PDU_SESSION_RESOURCE_RELEASE", "X2AP_UE_CONTEXT_RELEASE",
)


def lookup(table: dict, key: ColumnLike, default: Column | None = None) -> Column:
    """Small literal map as an expression; NULL or ``default`` for keys outside it."""
    found = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[col(key)]
    return found if default is None else F.coalesce(found, default)


def message_type(
    protocol: ColumnLike, is_request: ColumnLike, method: ColumnLike, code: ColumnLike
) -> Column:
    """Message type from SIP method / status, Diameter command code, GTP or PFCP type code."""
    protocol, is_request, code = col(protocol), F.coalesce(col(is_request), F.lit(False)), col(code).cast("int")
    found = (
        F.when((protocol == "SIP") & is_request, lookup(SIP_METHODS, method))
        .when(protocol == "SIP", lookup(SIP_STATUS, code))
        .when((protocol == "DIAMETER") & is_request, lookup(DIAMETER_REQUESTS, code))
        .when(protocol == "DIAMETER", lookup(DIAMETER_ANSWERS, code))
        .when(protocol == "GTP_C", lookup(GTP_TYPES, code))
        .when(protocol == "PFCP", lookup(PFCP_TYPES, code))
    )
    return F.coalesce(found, F.lit("UNKNOWN"))


def interface_of_ports(transport: ColumnLike, src_port: ColumnLike, dst_port: ColumnLike) -> Column:
    """Interface name from transport and well-known ports; the media port range comes last."""
    transport, ports = col(transport), (col(src_port), col(dst_port))

    def either(*wanted: int) -> Column:
        return ports[0].isin(list(wanted)) | ports[1].isin(list(wanted))

    chain_ = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, table in (("SCTP", SCTP_PORTS), ("UDP", UDP_PORTS), ("TCP", TCP_PORTS)):
        for port, interface in table.items():
            chain_ = chain_.when((transport == name) & either(port), interface)
    media = ports[0].between(*MEDIA_PORTS) | ports[1].between(*MEDIA_PORTS)
    return (
        chain_.when((transport == "UDP") & media, "IMS-RTP")
        .when((transport == "TCP") & either(*WEB_PORTS), "HTTP-API")
        .otherwise("Unknown")
    )


def direction_of_ports(src_port: ColumnLike, dst_port: ColumnLike) -> Column:
    """The side with the port below 10000 is the server."""
    src, dst = col(src_port), col(dst_port)
    return (
        F.when((src < 10000) & (dst > 10000), "SERVER_TO_CLIENT")
        .when((dst < 10000) & (src > 10000), "CLIENT_TO_SERVER")
        .otherwise("UNKNOWN")
    )


def diagram_interface(
    protocol: ColumnLike, src_role: ColumnLike, dst_role: ColumnLike, application_id: ColumnLike
) -> Column:
    """Interface label from protocol, endpoint roles and Diameter application id."""
    protocol, src, dst = col(protocol), col(src_role), col(dst_role)

    def between(a: str, b: str) -> Column:
        return ((src == a) & (dst == b)) | ((src == b) & (dst == a))

    def touches(role: str) -> Column:
        return F.coalesce(src == role, F.lit(False)) | F.coalesce(dst == role, F.lit(False))

    # Protocols whose label does not depend on the endpoints.
    plain = {
        "S1AP": "S1-MME", "NGAP": "N2", "PFCP": "N4", "SIP": "IMS", "RTP": "IMS", "RTCP": "IMS", "HTTP2": "SBI",
        "DNS": "DNS", "DHCP": "DHCP",
    }
    return (
        F.when((protocol == "GTP_U") & touches("ENODEB"), "S1-U")
        .when((protocol == "GTP_U") & touches("SGW"), "S5/S8-U")
        .when(protocol == "GTP_U", "GTP-U")
        .when((protocol == "GTP_C") & between("MME", "SGW"), "S11")
        .when((protocol == "GTP_C") & between("SGW", "PGW"), "S5/S8")
        .when(protocol == "GTP_C", "GTP-C")
        .when(
            protocol == "DIAMETER",
            lookup(DIAMETER_APPLICATIONS, col(application_id).cast("int"), F.lit("DIAMETER")),
        )
        .otherwise(lookup(plain, protocol, F.lit("UNKNOWN")))
    )


def service_of_path(path: ColumnLike) -> Column:
    """First path segment of an API call."""
    return F.get(F.split(col(path), "/"), 1)


def network_function(service: ColumnLike) -> Column:
    service = col(service)
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, function in SERVICE_PREFIXES.items():
        found = found.when(service.startswith(prefix), function)
    return found.otherwise("Unknown-NF")


def pdn_class(apn: ColumnLike) -> Column:
    name = F.lower(col(apn))
    return (
        F.when(name.contains("ims"), "IMS")
        .when(name.contains("emergency") | name.contains("sos"), "EMERGENCY")
        .when(name.contains("mms"), "MMS")
        .when(name.contains("internet") | name.contains("default"), "INTERNET")
        .otherwise("OTHER")
    )


def result_class(code: ColumnLike) -> Column:
    """Diameter result code family."""
    code = col(code)
    return (
        F.when(code.between(2000, 2999), "SUCCESS")
        .when(code.between(3000, 3999), "PROTOCOL_ERROR")
        .when(code.between(4000, 4999), "TRANSIENT_FAILURE")
        .when(code.between(5000, 5999), "PERMANENT_FAILURE")
        .otherwise("UNKNOWN")
    )


def short_description(protocol: ColumnLike, kind: ColumnLike, from_uri: ColumnLike) -> Column:
    """``protocol [type] [from user]``; the user only for SIP."""
    user = F.regexp_extract(col(from_uri), "sip:([^@]*)@", 1)
    return F.concat_ws(
        " ",
        col(protocol),
        F.when(col(kind) != "UNKNOWN", col(kind)),
        F.when((col(protocol) == "SIP") & (user != ""), F.concat(F.lit("from "), user)),
    )


def session_type(interfaces: ColumnLike, legs: ColumnLike) -> Column:
    """Session type from the set of interfaces seen and the number of legs."""
    seen = col(interfaces)

    def has(*names: str) -> Column:
        return F.arrays_overlap(seen, F.array(*[F.lit(n) for n in names]))

    legs = col(legs)
    return (
        F.when(has("IMS-SIP") & has("IMS-RTP"), "VoLTE-Call")
        .when(has("X2"), "LTE-Handover-X2")
        .when(has("N2") & has("N4") & (legs >= 2), "5G-PDU-Session")
        .when(has("N2") & has("N4"), "5G-Registration")
        .when(has("S1-MME") & has("S1-U", "S11") & (legs >= 3), "LTE-Attach")
        .when(has("S1-MME") & has("S1-U", "S11"), "LTE-PDN-Connect")
        .when(legs > 1, "Mixed")
        .otherwise("Incomplete")
    )


def interruption_quality(interruption_ms: ColumnLike) -> Column:
    """Quality band of a service interruption in milliseconds."""
    ms = col(interruption_ms)
    bands = [(50, "EXCELLENT"), (100, "GOOD"), (300, "ACCEPTABLE"), (1000, "POOR")]
    band = F.when(ms < 0, "INVALID").when(ms == 0, "SEAMLESS")
    for limit, name in bands:
        band = band.when(ms < limit, name)
    return band.when(ms.isNotNull(), "FAILED")


def score_confidence(score: ColumnLike) -> Column:
    """Confidence band of a match score."""
    score = col(score)
    return (
        F.when(score >= 0.95, "EXACT")
        .when(score >= 0.75, "HIGH")
        .when(score >= 0.5, "MEDIUM")
        .when(score >= 0.3, "LOW")
        .otherwise("NONE")
    )
