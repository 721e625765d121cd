"""Subscriber matching: fuzzy phone numbers and scored identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import score_confidence
from ..functions.identifiers import ipv6_prefix, party_address
from .hubs import salted_join

# Score of each way to match, in the order the cascade tries them.
SCORES = {
    "imsi": 1.0, "imei": 1.0, "imei_tac": 0.3, "guti": 1.0, "guti_pool": 0.4, "tmsi": 0.7, "msisdn": 1.0,
    "msisdn_national": 0.95, "msisdn_suffix9": 0.8, "msisdn_contained": 0.8, "msisdn_suffix7": 0.6, "ip_apn": 0.9, "teid": 0.85, "ip": 0.75,
    "ip_prefix": 0.5,
}
#: Numbers longer than this take part in containment matching.
SHORTEST_CONTAINED = 7
SUFFIX_DIGITS = 9


def number_matches(numbers: DataFrame, probes: DataFrame, containment: bool = False) -> DataFrame:
    """Distinct (``probe``, ``number``, ``how``) of matching normalised numbers; the strongest way only.

    Both frames hold ``phone``, a struct from :func:`signaloom.functions.phones.phone_number`; repeated numbers
    are folded first, so the work grows with distinct numbers. Equality of national, international and 9-digit
    suffix are equi-joins on an exploded key list; containment explodes every substring of at least 7 digits of
    the longer number and joins on that, so no block of numbers is ever compared pairwise.
    """
    ways = [("international", 1), ("national", 2), ("suffix", 3)]

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        once = frame.select("phone.*").distinct()
        suffix = F.when(F.length("digits") >= SUFFIX_DIGITS, F.expr(f"right(digits, {SUFFIX_DIGITS})"))
        entries = F.array(
            F.struct(F.lit(1).alias("rank"), F.when(F.col("international") != "", F.col("international")).alias("key")),
            F.struct(F.lit(2).alias("rank"), F.when(F.col("national") != "", F.col("national")).alias("key")),
            F.struct(F.lit(3).alias("rank"), suffix.alias("key")),
        )
        return once.select(F.col("digits").alias(name), F.inline(entries)).filter("key is not null").distinct()

    found = keyed(probes, "probe").join(keyed(numbers, "number"), ["rank", "key"]).select("probe", "number", "rank")
    if containment:
        for inner, outer, inner_name, outer_name in (
            (numbers, probes, "number", "probe"), (probes, numbers, "probe", "number")
        ):
            held = inner.select(F.col("phone.digits").alias(inner_name), F.col("phone.national").alias("key")).filter(
                F.length("key") >= SHORTEST_CONTAINED
            ).distinct()
            parts = outer.select(F.col("phone.digits").alias(outer_name), F.col("phone.national").alias("_n")).filter(
                F.length("_n") >= SHORTEST_CONTAINED
            ).distinct()
            sizes = F.sequence(F.lit(SHORTEST_CONTAINED), F.length("_n"))
            pieces = F.array_distinct(F.flatten(F.transform(
                sizes,
                lambda size: F.transform(
                    F.sequence(F.lit(1), F.length("_n") - size + 1), lambda at: F.col("_n").substr(at, size)
                ),
            )))
            hit = parts.select(outer_name, F.explode(pieces).alias("key")).join(held, "key")
            found = found.unionByName(hit.select("probe", "number", F.lit(4).alias("rank")))
    names = F.element_at(F.array(*[F.lit(w) for w, _ in ways], F.lit("containment")), F.col("rank"))
    best = found.groupBy("probe", "number").agg(F.min("rank").alias("rank"))
    return best.select("probe", "number", names.alias("how"))


def identity_score(left: str, right: str) -> tuple[Column, Column]:
    """(cascade score, highest score) of two identity structs, as column expressions.

    Struct fields: imsi, imei, mcc, mnc, mme_group_id, tmsi, digits, national, international, ipv4, ipv6, apn, teid.
    The cascade takes the first family that matches at all; the second value is the best of all families.
    """

    def same(name: str) -> Column:
        return F.coalesce(F.col(f"{left}.{name}") == F.col(f"{right}.{name}"), F.lit(False))

    def tail(side: str, size: int) -> Column:
        digits = F.col(f"{side}.digits")
        return F.when(F.length(digits) >= size, digits.substr(F.length(digits) - size + 1, F.lit(size)))

    def ends(size: int) -> Column:
        return F.coalesce(tail(left, size) == tail(right, size), F.lit(False))

    national = [F.col(f"{s}.national") for s in (left, right)]
    contained = F.coalesce(
        (F.length(national[0]) > 6) & (F.length(national[1]) > 6)
        & (national[0].contains(national[1]) | national[1].contains(national[0])),
        F.lit(False),
    )
    network = same("mcc") & same("mnc")
    prefix = F.coalesce(ipv6_prefix(F.col(f"{left}.ipv6")) == ipv6_prefix(F.col(f"{right}.ipv6")), F.lit(False))
    address = (
        F.when(same("ipv4") | same("ipv6"), SCORES["ip"]).when(prefix, SCORES["ip_prefix"]).otherwise(0.0)
    )
    tac = F.coalesce(
        F.col(f"{left}.imei").substr(1, 8) == F.col(f"{right}.imei").substr(1, 8), F.lit(False)
    )
    with_apn = F.when((address > 0) & same("apn"), SCORES["ip_apn"]).otherwise(0.0)
    families = [
        F.when(same("imsi"), SCORES["imsi"]).otherwise(0.0),
        F.when(same("imei"), SCORES["imei"]).when(tac, SCORES["imei_tac"]).otherwise(0.0),
        F.when(network & same("tmsi"), SCORES["guti"])
        .when(network & same("mme_group_id"), SCORES["guti_pool"])
        .when(same("tmsi"), SCORES["tmsi"])
        .otherwise(0.0),
        F.when(same("international"), SCORES["msisdn"])
        .when(same("national"), SCORES["msisdn_national"])
        .when(ends(9) | contained, SCORES["msisdn_suffix9"])
        .when(ends(7), SCORES["msisdn_suffix7"])
        .otherwise(0.0),
        with_apn,
        F.when(same("teid"), SCORES["teid"]).otherwise(0.0),
        address,
    ]
    cascade = F.coalesce(*[F.when(f > 0, f) for f in families], F.lit(0.0))
    return cascade, F.greatest(*families)


def _substrings(text: Column, shortest: int) -> Column:
    """Distinct substrings of at least ``shortest`` characters; none of a shorter text."""
    sizes = F.when(F.length(text) >= shortest, F.sequence(F.lit(shortest), F.length(text))).otherwise(F.array().cast("array<int>"))
    cuts = lambda size: F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: text.substr(at, size))
    return F.array_distinct(F.flatten(F.transform(sizes, cuts)))


def match_registry(
    probes: DataFrame, registry: DataFrame, probe_id: str, entity_id: str, cascade: bool = False, hub_rows: int | None = None
) -> DataFrame:
    """Best entity of a registry for every probe: (probe id, entity id, ``how``, ``score``, ``confidence``).

    Each side is a flat frame with the identity columns of :func:`identity_score`; an entity with several endpoints has
    several rows. The highest score over all ways to match wins, then the earlier way, then the lowest entity: the
    second value of :func:`identity_score`, over all entities. ``cascade`` takes the first way that hits instead.

    Every key value of the registry is first folded to one entity (the lowest id), so a value shared by many entities
    costs one row, and a probe meets at most one candidate per key. Values that very many probes share (a device
    model, a pool) are salted. Containment of national numbers joins the substrings of either side with the whole
    numbers of the other.
    """

    def keys(frame: DataFrame, owner: str, whole: str, part: str) -> DataFrame:
        digits = F.col("digits")
        tail = lambda n: F.when(F.length(digits) >= n, F.expr(f"right(digits, {n})"))
        joined = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("/", a, b))
        network = F.when(F.col("mcc").isNotNull() & F.col("mnc").isNotNull(), F.concat_ws("-", "mcc", "mnc"))
        prefix = ipv6_prefix("ipv6")
        long = F.when(F.length("national") >= SHORTEST_CONTAINED, F.col("national"))
        values = {
            "imsi": [F.col("imsi")],
            "imei": [F.col("imei")],
            "imei_tac": [F.col("imei").substr(1, 8)],
            "guti": [joined(network, F.col("tmsi").cast("string"))],
            "guti_pool": [joined(network, F.col("mme_group_id").cast("string"))],
            "tmsi": [F.col("tmsi").cast("string")],
            "msisdn": [F.col("international")],
            "msisdn_national": [F.col("national")],
            "msisdn_suffix9": [tail(9)],
            "msisdn_contained": [F.concat(F.lit(f"{whole}:"), long)],
            "msisdn_suffix7": [tail(7)],
            "ip_apn": [joined(F.col("ipv4"), F.col("apn")), joined(F.col("ipv6"), F.col("apn")), joined(prefix, F.col("apn"))],
            "teid": [F.col("teid").cast("string")],
            "ip": [F.col("ipv4"), F.col("ipv6")],
            "ip_prefix": [prefix],
        }
        entry = lambda way, value: F.struct(F.lit(way).alias("how"), value.alias("value"))
        parts = F.transform(
            _substrings(F.coalesce(long, F.lit("")), SHORTEST_CONTAINED), lambda s: entry("msisdn_contained", F.concat(F.lit(f"{part}:"), s))
        )
        entries = F.concat(F.array(*[entry(way, value) for way, found in values.items() for value in found]), parts)
        return frame.select(F.col(owner), F.inline(entries)).filter("value is not null and value <> ''").distinct()

    one_each = (
        keys(registry, entity_id, "registry", "probe").groupBy("how", "value").agg(F.min(entity_id).alias(entity_id))
    )
    hits = salted_join(keys(probes, probe_id, "probe", "registry"), one_each, ["how", "value"], hub_rows=hub_rows)
    rank = F.array_position(F.array(*[F.lit(k) for k in SCORES]), F.col("how"))
    score = F.create_map(*[x for k, v in SCORES.items() for x in (F.lit(k), F.lit(v))])[F.col("how")]
    lead = rank if cascade else -score
    ordered = F.struct(lead.alias("lead"), rank.alias("rank"), F.col(entity_id), F.col("how"), score.alias("score"))
    picked = hits.groupBy(probe_id).agg(F.min(ordered).alias("_best")).select(probe_id, f"_best.{entity_id}", "_best.how", "_best.score")
    return picked.withColumn("confidence", score_confidence("score"))


def address_owners(
    rows: DataFrame, owners: DataFrame, addresses: tuple[str, ...], owner: str, two_groups: bool = False, hub_rows: int | None = None
) -> DataFrame:
    """Every row with ``matches`` and the lowest ``owner`` of a user address that fits one of its ``addresses``.

    IPv4 addresses must be equal, IPv6 addresses share their prefix (two groups of it with ``two_groups``). The owners
    of an address are folded to one row first, hot addresses are salted; each of ``addresses`` is a join of its own, and
    rows without any owner keep NULL and 0.
    """
    keys = F.array(*[party_address(c, two_groups) for c in addresses])
    held = owners.select(F.col(owner).alias("_owner"), F.explode(keys).alias("_address")).filter("_address is not null")
    folded = held.groupBy("_address").agg(F.min("_owner").alias("_owner"), F.count_distinct("_owner").alias("_n"))
    found = rows
    for at, column in enumerate(addresses):
        per_key = folded.select(F.col("_address").alias("_key"), F.col("_owner").alias(f"_owner{at}"), F.col("_n").alias(f"_n{at}"))
        found = salted_join(found.withColumn("_key", party_address(column, two_groups)), per_key, ["_key"], "left", hub_rows=hub_rows).drop("_key")
    least = F.array_min(F.array(*[F.col(f"_owner{at}") for at in range(len(addresses))]))
    total = sum((F.coalesce(F.col(f"_n{at}"), F.lit(0)) for at in range(len(addresses))), F.lit(0))
    return found.select(*rows.columns, least.alias(owner), total.cast("bigint").alias("matches"))


def same_pool(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("mcc", "mnc", "mme_group_id")) -> DataFrame:
    """Distinct pool rows on both sides with how many members each side has; never member pairs."""
    sizes = lambda f, name: f.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    return sizes(left, "left_members").join(sizes(right, "right_members"), list(columns))
