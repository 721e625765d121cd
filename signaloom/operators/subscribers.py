"""Subscriber registry: identity observations merged into people, with what each was seen with and how sure that is.

Permanent identifiers (imsi, msisdn, imei) always mean the same person. Temporary ones (TMSI, GUTI, addresses, tunnels) are
handed on: each value is cut into tenures, and only observations of one tenure meet through it. A tenure ends when the value
turns up with another imsi than it last had, or after ``valid_within`` without being seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import axis
from ..functions.identifiers import ipv6_prefix, subscriber_key
from ..session import cut_lineage
from .asof import first_by_precedence
from .components import merge_by_keys
from .timeline import Slab, carry_along, fit_slab, last_known, previous, running

PERMANENT = ("imsi", "msisdn", "imei")
#: Columns of an observation that name a temporary identifier; a GUTI also tells the TMSI it ends in.
TEMPORARY = ("tmsi", "guti", "ipv4", "ipv6", "tunnel")
# Weight of what is known in the completeness score.
COMPLETENESS = {"imsi": 0.3, "msisdn": 0.3, "imei": 0.2, "address": 0.2}


def tunnel_key(peer: Column, teid: Column) -> Column:
    """A tunnel is known by its peer's address and its id."""
    return F.when(teid.isNotNull(), F.concat_ws("/", F.coalesce(peer, F.lit("")), teid.cast("string")))


def temporary_keys(columns: Sequence[str]) -> Column:
    """ARRAY of the ``type:value`` texts of the temporary identifiers in these columns; IPv6 counts by its /64 prefix."""
    def text(name: str, value: Column) -> Column:
        value = value.cast("string")
        return F.when(value != "", F.concat(F.lit(f"{name}:"), value))

    keys = []
    for name in (c for c in TEMPORARY if c in columns):
        keys.append(text(name, ipv6_prefix(name) if name == "ipv6" else F.col(name)))
        if name == "guti":
            keys.append(text("tmsi", F.substring_index("guti", "-", -1)))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def tenures(observations: DataFrame, row_id: str, ts: str, valid_within_seconds: int | None = None, slab: Slab = None) -> DataFrame:
    """(row id, ``key``, ``tenure``, ``at``, ``imsi``) of every temporary identifier of every observation.

    Tenures of a key are numbered from 0 in the order of time, ties by row id. Observations without an imsi belong to the tenure that
    is running; without a time, to the first. A value seen by a third of all observations is walked in slabs.
    """
    held = observations.select(
        row_id, F.coalesce(axis(observations, ts), F.lit(0)).alias("at"), "imsi", F.explode(temporary_keys(observations.columns)).alias("key")
    )
    held = cut_lineage(held, "held")
    slab = fit_slab(held, ["key"], "at") if slab is None else slab
    walked = carry_along(
        held, ["key"], ["at", row_id], slab, holder=last_known(F.when(F.col("imsi") != "", F.col("imsi"))), before=previous(F.col("at"))
    )
    handed_on = F.coalesce((F.col("imsi") != "") & (F.col("imsi") != F.col("holder")), F.lit(False))
    if valid_within_seconds is not None:
        handed_on = handed_on | F.coalesce(F.col("at") - F.col("before") > valid_within_seconds * 1_000_000, F.lit(False))
    marked = walked.select(row_id, "key", "at", "imsi", handed_on.cast("bigint").alias("_new"))
    return carry_along(marked, ["key"], ["at", row_id], slab, tenure=running("sum", F.col("_new"))).drop("_new")


def merge_subscribers(
    observations: DataFrame, row_id: str, ts: str, valid_within_seconds: int | None = None, slab: Slab = None
) -> tuple[DataFrame, DataFrame]:
    """Observations with ``subscriber_id`` (the smallest row id of the person), and the keys of each person, both written.

    The keys are (``key, valid_from, subscriber_id``): a permanent key holds from the beginning, a temporary one from the start of
    each tenure until the next. Observations without any identifier are left out.
    """
    held = cut_lineage(tenures(observations, row_id, ts, valid_within_seconds, slab), "tenures")
    node = F.concat_ws("#", "key", F.col("tenure").cast("string"))
    temporary = held.groupBy(row_id).agg(F.array_sort(F.collect_set(node)).alias("_temporary"))  # a handful per observation
    permanent = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in PERMANENT]))
    rows = observations.join(temporary, row_id, "left").withColumn(
        "_nodes", F.concat(permanent, F.coalesce("_temporary", F.array().cast("array<string>")))
    )
    merged = cut_lineage(merge_by_keys(rows.drop("_temporary"), "_nodes", row_id, "subscriber_id"), "subscribers")
    of_row = merged.select(row_id, "subscriber_id")
    starts = held.groupBy("key", "tenure").agg(F.min(F.struct("at", row_id)).alias("_first"))
    starts = starts.select("key", F.when(F.col("tenure") == 0, F.lit(0)).otherwise(F.col("_first.at")).cast("bigint").alias("valid_from"), f"_first.{row_id}")
    lasting = merged.select("subscriber_id", F.explode(permanent).alias("key")).distinct()
    keys = starts.join(of_row, row_id).select("key", "valid_from", "subscriber_id").unionByName(
        lasting.select("key", F.lit(0).cast("bigint").alias("valid_from"), "subscriber_id")
    )
    return merged, cut_lineage(keys.groupBy("key", "valid_from").agg(F.min("subscriber_id").alias("subscriber_id")), "keys")


def resolve(rows: DataFrame, row_id: str, ts: str, keys: Sequence[Column], registry: DataFrame, slab: Slab = None) -> DataFrame:
    """(row id, ``subscriber_id``) of rows of any source: the first of ``keys`` (``type:value`` texts) that was someone's then."""
    held = registry.withColumn("_tie", F.col("subscriber_id"))
    return first_by_precedence(rows, held, row_id, keys, axis(rows, ts), "key", F.col("valid_from"), "_tie", "subscriber_id", slab)


def attribute_values(merged: DataFrame, attributes: Sequence[str], confidence: Column, ts: str) -> DataFrame:
    """Child table (``subscriber_id, attribute, value, confidence, first_seen, last_seen, observations``).

    The confidence of a value is the highest that any observation of it had.
    """
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    named = merged.select("subscriber_id", F.col(ts).alias("_ts"), confidence.cast("double").alias("_c"), F.inline(entries))
    return named.filter("value <> ''").groupBy("subscriber_id", "attribute", "value").agg(
        F.max("_c").alias("confidence"), F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen"), F.count(F.lit(1)).alias("observations")
    )


def surest_values(values: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per subscriber: of each attribute the value of highest confidence (ties: seen first, then the smaller) and that."""
    better = F.struct(-F.col("confidence"), "first_seen", "value")
    return values.groupBy("subscriber_id").agg(*[
        c for a in attributes for c in (
            F.min_by("value", F.when(F.col("attribute") == a, better)).alias(a),
            F.max(F.when(F.col("attribute") == a, F.col("confidence"))).alias(f"{a}_confidence"),
        )
    ])


def subscriber_table(merged: DataFrame, values: DataFrame, ts: str, row_id: str) -> DataFrame:
    """One row per person: surest permanent identifiers, current GUTI and TMSI, endpoints, span and completeness."""
    at = F.struct(ts, row_id)

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(f"current_{name}")

    seen = merged.groupBy("subscriber_id").agg(
        latest("guti"), latest("tmsi"), latest("ipv4"), latest("ipv6"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("observations"),
    )
    counts = values.groupBy("subscriber_id").agg(*[
        F.count_if(F.col("attribute") == a).alias(f"{a}_values") for a in ("guti", "ipv4", "ipv6", "tunnel")
    ])
    whole = seen.join(surest_values(values, PERMANENT), "subscriber_id", "left").join(counts, "subscriber_id", "left")
    whole = whole.na.fill(0, [f"{a}_values" for a in ("guti", "ipv4", "ipv6", "tunnel")])
    known = {**{c: F.col(c).isNotNull() for c in PERMANENT}, "address": F.col("ipv4_values") + F.col("ipv6_values") + F.col("tunnel_values") > 0}
    score = sum((F.when(known[name], weight).otherwise(0.0) for name, weight in COMPLETENESS.items()), F.lit(0.0))
    return whole.withColumn("completeness", score).withColumn("primary_key", subscriber_key(*PERMANENT))


def bearer_table(messages: DataFrame, owners: DataFrame, row_id: str, order: Sequence[str]) -> DataFrame:
    """Child table of bearers (``subscriber_id, teid, ebi``): latest class, made and removed when; active until removed.

    ``messages`` has teid, ebi, qci and ``removes`` (whether it deletes the bearer); ``owners`` as :func:`resolve` gives them.
    """
    owned = messages.join(owners, row_id)
    at = F.struct(*order)
    rolled = owned.groupBy("subscriber_id", "teid", "ebi").agg(
        F.max_by("qci", F.when(F.col("qci").isNotNull(), at)).alias("qci"), F.min(order[0]).alias("created_ts"),
        F.max(F.when(~F.col("removes"), F.col(order[0]))).alias("_used"), F.max(F.when(F.col("removes"), F.col(order[0]))).alias("_removed"),
    )
    gone = F.col("_removed").isNotNull() & (F.col("_used").isNull() | (F.col("_removed") >= F.col("_used")))
    return rolled.withColumn("deleted_ts", F.when(gone, F.col("_removed"))).withColumn("active", ~gone).drop("_used", "_removed")


def coverage(subscribers: DataFrame, bearers: DataFrame) -> DataFrame:
    """How many people there are and how many are known by each attribute or have an active bearer."""
    active = bearers.filter("active").select("subscriber_id").distinct().withColumn("_active", F.lit(True))
    whole = subscribers.join(active, "subscriber_id", "left")
    return whole.agg(
        F.count(F.lit(1)).alias("subscribers"), *[F.count(c).alias(f"with_{c}") for c in PERMANENT], F.count("current_guti").alias("with_guti"),
        F.count_if(F.col("ipv4_values") + F.col("ipv6_values") > 0).alias("with_address"), F.count_if(F.col("tunnel_values") > 0).alias("with_tunnel"),
        F.count("_active").alias("with_active_bearer"),
    )
