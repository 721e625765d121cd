"""Subscriber and device identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnLike, blank_to_null, col

# Mobile country codes whose network code has three digits.
THREE_DIGIT_MNC = (
    "302", "310", "311", "312", "313", "316", "334", "338", "342", "344", "346", "348", "350", "352", "354",
    "356", "358", "360", "362", "363", "364", "365", "366", "368", "370", "372", "374", "376", "732",
)
# Range of valid mobile country codes.
MCC_RANGE = ("200", "799")


def imsi(text: ColumnLike) -> Column:
    """STRUCT<digits, mcc, mnc, msin>, NULL unless the text holds a valid 15-digit IMSI."""
    user = F.regexp_replace(F.substring_index(col(text), "@", 1), "^(imsi-|imsi:|IMSI)", "")
    digits = F.regexp_replace(user, "[^0-9]", "")
    mcc = digits.substr(1, 3)
    three = mcc.isin(list(THREE_DIGIT_MNC))
    parts = F.struct(
        digits.alias("digits"),
        mcc.alias("mcc"),
        F.when(three, digits.substr(4, 3)).otherwise(digits.substr(4, 2)).alias("mnc"),
        F.when(three, digits.substr(7, 9)).otherwise(digits.substr(6, 10)).alias("msin"),
    )
    return F.when((F.length(digits) == 15) & mcc.between(*MCC_RANGE), parts)


def imei(text: ColumnLike) -> Column:
    """STRUCT<imei, imeisv, tac, snr, check_ok>; a wrong check digit is flagged, not refused."""
    bare = F.regexp_replace(col(text), "^(imei-|imei:|IMEI|imeisv-|imeisv:)", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    size = F.length(digits)
    parts = F.struct(
        digits.substr(1, 14).alias("imei"),
        F.when(size == 16, digits).alias("imeisv"),
        digits.substr(1, 8).alias("tac"),
        digits.substr(9, 6).alias("snr"),
        F.when(size == 15, F.call_function("luhn_check", digits)).alias("check_ok"),
    )
    return F.when(size.between(14, 16), parts)


def uri_user(uri: ColumnLike) -> Column:
    """User part of a SIP URI, empty when there is none."""
    return F.regexp_extract(col(uri), "sip:([^@]+)@", 1)


def uri_host(uri: ColumnLike) -> Column:
    return F.regexp_extract(col(uri), "sip:[^@]+@([^:;>]+)", 1)


def ipv6_prefix(address: ColumnLike) -> Column:
    """The /64 part (four groups) of a written-out IPv6 address; NULL for IPv4."""
    address = col(address)
    return F.when(address.contains(":"), F.substring_index(address, ":", 4))


def ipv6_two_groups(address: ColumnLike) -> Column:
    """The first two groups, for parity with address comparison inside call matching."""
    address = col(address)
    return F.when(address.contains(":"), F.substring_index(address, ":", 2))


def party_address(address: ColumnLike, two_groups: bool = False) -> Column:
    """Equality key for a user address: the address itself for IPv4, its prefix for IPv6."""
    prefix = ipv6_two_groups(address) if two_groups else ipv6_prefix(address)
    return F.coalesce(prefix, blank_to_null(address))


def subscriber_key(imsi_digits: ColumnLike, msisdn: ColumnLike, imei_digits: ColumnLike) -> Column:
    """Most stable identifier first: imsi, then phone number, then device."""
    return F.coalesce(
        F.concat(F.lit("imsi:"), col(imsi_digits)),
        F.concat(F.lit("msisdn:"), col(msisdn)),
        F.concat(F.lit("imei:"), col(imei_digits)),
    )
