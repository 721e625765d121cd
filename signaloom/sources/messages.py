"""Decoded-message tables: declared schemas, batch and streaming readers, key extraction from JSON bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns of a decoded message row.
MESSAGE_SCHEMA = (
    "message_id bigint, ts timestamp, frame_number bigint, interface string, protocol string, message_type string, "
    "src_ip string, src_port int, dst_ip string, dst_port int, payload_length bigint, imsi string, supi string, "
    "msisdn string, icid string, sip_call_id string, ue_ipv4 string, ue_ipv6 string, teid_s1u bigint, "
    "teid_s5u bigint, seid_n4 decimal(20,0), eps_bearer_id int, mme_ue_s1ap_id bigint, enb_ue_s1ap_id bigint, "
    "apn string, parsed_data string"
)
RTP_SCHEMA = (
    "frame_number bigint, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, payload_type int, "
    "sequence_number int, rtp_timestamp bigint, ssrc bigint, payload_size int"
)


def read_messages(spark: SparkSession, path: str, schema: str | StructType = MESSAGE_SCHEMA, format: str = "parquet") -> DataFrame:
    """Rows of a message folder with a declared schema; no inference pass over the data."""
    return spark.read.schema(schema).format(format).load(path)


def stream_messages(
    spark: SparkSession, path: str, schema: str | StructType = MESSAGE_SCHEMA, format: str = "parquet", files_per_trigger: int = 100
) -> DataFrame:
    """The same folder as a stream of new files."""
    return (
        spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def union_captures(captures: dict[str, DataFrame], interface: str = "interface_id") -> DataFrame:
    """Rows of several captures with the capture's name in ``interface``; missing columns become NULL."""
    named = [frame.withColumn(interface, F.lit(name)) for name, frame in captures.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _digits(value: Column, shortest: int, longest: int) -> Column:
    return value.rlike(f"^[0-9]{{{shortest},{longest}}}$")


#: The fields of a message body that hold identifiers.
BODY_SCHEMA = (
    "struct<header:struct<teid:bigint,seid:decimal(20,0)>,imsi:string,msisdn:string,ue_ip_address:string,"
    "call_id:string,p_charging_vector:struct<icid_value:string>,p_asserted_identity:array<struct<username:string>>,"
    "authorization_username:string,p_associated_uri:array<string>,sdp:struct<connection_address:string>,"
    "subscription_ids:array<struct<type:int,data:string>>,user_name:string,ran_ue_ngap_id:decimal(20,0),"
    "amf_ue_ngap_id:decimal(20,0),ue_ipv4:string>"
)


def correlation_keys(protocol: str = "protocol", body: str = "body") -> dict[str, Column]:
    """Identifier columns out of a message's parsed body (:data:`BODY_SCHEMA`), by protocol.

    A user name of 14 or 15 digits is an IMSI, one of 10 to 15 (or with ``+``) a phone number.
    """
    kind = F.col(protocol)
    parsed = F.col(body)
    is_ = lambda *names: kind.isin(*names)

    users = F.transform(parsed["p_asserted_identity"], lambda p: p["username"])
    uri_users = F.transform(parsed["p_associated_uri"], lambda u: F.regexp_extract(u, "sip:([^@]*)@", 1))
    first_imsi = lambda names: F.get(F.filter(names, lambda u: _digits(u, 14, 15)), 0)
    authorised = F.when(_digits(parsed["authorization_username"], 14, 15), parsed["authorization_username"])
    sip_imsi = F.coalesce(first_imsi(users), authorised, first_imsi(uri_users))
    phones = F.filter(
        users,
        lambda u: u.startswith("+") | (_digits(u, 10, 15) & ~F.coalesce(u == sip_imsi, F.lit(False))),
    )
    sip_phone = F.regexp_replace(F.try_element_at(phones, F.lit(-1)), r"^\+", "")
    of_type = lambda wanted: F.filter(parsed["subscription_ids"], lambda s: s["type"] == wanted)
    subscription = lambda wanted: F.get(of_type(wanted), 0)["data"]
    user_name = F.when(_digits(parsed["user_name"], 14, 15), parsed["user_name"])
    address = parsed["sdp"]["connection_address"]
    return {
        "imsi": F.when(is_("SIP"), sip_imsi)
        .when(is_("DIAMETER"), F.coalesce(user_name, subscription(1), parsed["imsi"]))
        .when(is_("GTP_C", "GTP_U", "PFCP"), parsed["imsi"]),
        "msisdn": F.when(is_("SIP"), sip_phone)
        .when(is_("DIAMETER"), F.coalesce(subscription(0), parsed["msisdn"]))
        .when(is_("GTP_C", "GTP_U"), parsed["msisdn"]),
        "icid": F.when(is_("SIP"), parsed["p_charging_vector"]["icid_value"]),
        "sip_call_id": F.when(is_("SIP"), parsed["call_id"]),
        "ue_ipv4": F.coalesce(
            F.when(is_("PFCP"), parsed["ue_ip_address"]),
            F.when(is_("SIP") & ~address.contains(":"), address),
            parsed["ue_ipv4"],
        ),
        "ue_ipv6": F.when(is_("SIP") & address.contains(":"), address),
        "teid_s1u": F.when(is_("GTP_C", "GTP_U"), parsed["header"]["teid"]),
        "seid_n4": F.when(is_("PFCP"), parsed["header"]["seid"]),
        "ran_ue_ngap_id": F.when(is_("SCTP"), parsed["ran_ue_ngap_id"]),
        "amf_ue_ngap_id": F.when(is_("SCTP"), parsed["amf_ue_ngap_id"]),
    }


def with_correlation_keys(messages: DataFrame, protocol: str = "protocol", body: str = "parsed_data") -> DataFrame:
    """Adds the identifier columns. The JSON body is parsed once, in a projection of its own below them."""
    parsed = messages.withColumn("_body", F.from_json(F.col(body), BODY_SCHEMA))
    return parsed.withColumns(correlation_keys(protocol, "_body")).drop("_body")
