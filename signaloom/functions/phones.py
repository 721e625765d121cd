"""Phone numbers out of SIP URIs, TEL URIs, prefixed and bare texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnLike, col, once

# Country calling codes that are recognised.
COUNTRY_CODES = (
    "1", "7", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55",
    "61", "81", "82", "86", "90", "91", "351", "353", "358", "420", "421",
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def without_leading_zeros(digits: ColumnLike) -> Column:
    """Drops leading zeros; an all-zero or empty text becomes ``0``."""
    return once(F.regexp_replace(col(digits), "^0+", ""), lambda rest: F.when(rest == "", "0").otherwise(rest))


def country_code(digits: ColumnLike) -> Column:
    """Longest known calling code that is shorter than the number, else an empty text."""
    digits = col(digits)
    tries = []
    for width in (3, 2, 1):
        prefix = digits.substr(1, width)
        known = [c for c in COUNTRY_CODES if len(c) == width]
        tries.append(F.when((F.length(digits) > width) & prefix.isin(known), prefix))
    return F.coalesce(*tries, F.lit(""))


def phone_number(text: ColumnLike) -> Column:
    """STRUCT<digits, country, national, international> of a raw subscriber number."""
    text = col(text)
    is_sip = text.rlike("^sips?:")
    is_tel = text.startswith("tel:")
    # In steps, each worked out once per row: what a step names, the next ones read as often as they need.
    form = once(F.struct(text.alias("text"), is_sip.alias("sip"), is_tel.alias("tel")), lambda t: F.struct(
        t["text"].alias("text"), t["sip"].alias("sip"), F.when(t["sip"] | t["tel"], _uri_digits(t["text"], t["sip"])).alias("uri_digits")
    ))
    digits = once(form, lambda t: F.struct(
        t["text"].alias("text"), t["sip"].alias("sip"), t["uri_digits"].alias("uri_digits"),
        F.coalesce(F.when(t["uri_digits"] != "", t["uri_digits"]), _digits(F.regexp_replace(t["text"], "^msisdn-", ""))).alias("digits"),
    ))
    country = once(digits, lambda t: F.struct(
        t["digits"].alias("digits"),
        F.when(_states_country(t["text"], t["sip"], t["uri_digits"]), country_code(t["digits"])).otherwise("").alias("country"),
    ))
    return once(country, lambda p: F.struct(
        p["digits"].alias("digits"),
        p["country"].alias("country"),
        without_leading_zeros(p["digits"].substr(F.length(p["country"]) + 1, F.length(p["digits"]))).alias("national"),
        p["digits"].alias("international"),
    ))


def _uri_digits(text: Column, is_sip: Column) -> Column:
    """Digits of a URI's user part, without its parameters."""
    body = F.regexp_replace(text, "^(sips?:|tel:)", "")
    body = F.when(is_sip, F.substring_index(body, "@", 1)).otherwise(body)
    return _digits(F.substring_index(body, ";", 1))


def _states_country(text: Column, is_sip: Column, uri_digits: Column) -> Column:
    """A number that is no URI's may begin with a calling code; a URI's has to be in international form."""
    bare = (F.coalesce(uri_digits, F.lit("")) == "") & text.isNotNull()
    return bare | text.contains("+") | (is_sip & (F.length(uri_digits) > 10))


def is_digits(text: ColumnLike, shortest: int, longest: int) -> Column:
    return col(text).rlike(f"^[0-9]{{{shortest},{longest}}}$")
