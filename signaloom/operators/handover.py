"""Handovers: key changes, type and quality of a handover, tunnel life and volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import interruption_quality
from ..functions.core import axis, millis
from .asof import asof_join
from .timeline import Slab, carry_along, fit_slab, previous

# Cause code of an accepted request; messages that ask for and confirm a handover.
ACCEPTED = 16
REQUESTS = ("S1AP_HANDOVER_REQUEST", "NGAP_HANDOVER_REQUEST")
ACKS = ("S1AP_HANDOVER_REQUEST_ACK", "NGAP_HANDOVER_REQUEST_ACK")
NOTIFIES = ("S1AP_HANDOVER_NOTIFY", "NGAP_HANDOVER_NOTIFY")


def key_changes(
    messages: DataFrame, by: Sequence[str], order: Sequence[str], key: str, carried: Sequence[str] = (), slab: Slab = None
) -> DataFrame:
    """Rows where ``key`` (tunnel id) differs from the entity's previous row, with ``old_*`` values."""
    before = F.struct(key, *carried)
    narrow = messages.select(*by, *order, key, *carried)
    walked = carry_along(narrow, by, order, slab, _before=previous(before))
    changed = F.col("_before").isNotNull() & (F.col(key) != F.col(f"_before.{key}"))
    return walked.filter(changed).select(
        "*", *[F.col(f"_before.{c}").alias(f"old_{c}") for c in (key, *carried)]
    ).drop("_before")


def interruptions(
    changes: DataFrame, activity: DataFrame, by: Sequence[str], key: str, ts: str, tie: str, slab: Slab = None
) -> DataFrame:
    """Adds ``interruption_ms``: from the last activity on the old key to the change.

    ``activity`` has the entity, the key, a time and a tie column; only rows strictly before the change count.
    """
    seen = activity.select(*by, F.col(key).alias(f"old_{key}"), axis(activity, ts).alias("_active_at"), F.col(tie).alias("_tie"))
    # Changes are some of the rows of activity, so fitting to the activity fits both.
    slab = fit_slab(seen, [*by, f"old_{key}"], "_active_at") if slab is None else slab
    found = asof_join(
        changes, seen, [*by, f"old_{key}"], axis(changes, ts) - 1, F.col("_active_at"), "_tie", slab=slab, name="_seen"
    )
    quiet = millis(axis(found, ts) - F.col("_seen._active_at"))
    return (
        found.withColumn("interruption_ms", quiet)
        .withColumn("quality", interruption_quality("interruption_ms"))
        .drop("_seen")
    )


def handover_type(protocol: Column, kind: Column, stated: Column) -> Column:
    """X2, S1 or N2 from protocol and message; else what the message states; a changed bearer counts as X2."""
    return (
        F.when(protocol == "X2AP", "X2")
        .when((protocol == "S1AP") & kind.isin("S1AP_HANDOVER_REQUEST", "S1AP_PATH_SWITCH_REQUEST"), "S1")
        .when((protocol == "NGAP") & kind.isin("NGAP_HANDOVER_REQUEST", "NGAP_PATH_SWITCH_REQUEST"), "N2")
        .when(stated != "", stated)
        .when(kind == "GTP_MODIFY_BEARER_RESP", "X2")
        .otherwise("UNKNOWN")
    )


def handover_succeeded(kind: Column, cause: Column, has_error: Column) -> Column:
    """The cause decides when there is one; otherwise a response without an error or a notify is a success."""
    return F.when(cause.isNotNull(), cause == ACCEPTED).otherwise(
        ((kind == "GTP_MODIFY_BEARER_RESP") & ~has_error) | kind.isin(list(NOTIFIES))
    )


def preparation_time(messages: DataFrame, by: Sequence[str], ts: str, kind: str) -> DataFrame:
    """First request to first acknowledgement per entity, 0 when one is missing."""
    at = axis(messages, ts)
    first = lambda names: F.min(F.when(F.col(kind).isin(list(names)), at))
    return messages.groupBy(*by).agg(
        F.coalesce(millis(first(ACKS) - first(REQUESTS)), F.lit(0)).alias("preparation_ms")
    )


def handover_statistics(handovers: DataFrame, success: str = "success", interruption: str = "interruption_ms") -> DataFrame:
    total, good = F.count(F.lit(1)), F.count_if(F.col(success))
    return handovers.agg(
        total.alias("total_handovers"),
        good.alias("successful_handovers"),
        (total - good).alias("failed_handovers"),
        F.when(total > 0, good * 100.0 / total).otherwise(0.0).alias("success_rate_percent"),
        F.avg(interruption).alias("avg_interruption_ms"),
        F.min(interruption).alias("min_interruption_ms"),
        F.max(interruption).alias("max_interruption_ms"),
    )


def tunnel_timeline(**events: DataFrame) -> DataFrame:
    """One time-ordered list of (``entity``, ``ts``, ``event``, ``detail``) from several event frames."""
    parts = [f.select("entity", "ts", F.lit(name).alias("event"), F.col("detail").cast("string").alias("detail")) for name, f in events.items()]
    first, *rest = parts
    for more in rest:
        first = first.unionByName(more)
    return first.orderBy("entity", "ts", "event", "detail")


def tunnel_statistics(tunnels: DataFrame) -> DataFrame:
    """Tunnels by state with their handovers, echoes and bytes."""
    return tunnels.agg(
        F.count(F.lit(1)).alias("tunnels"),
        F.count_if(F.col("state") == "ACTIVE").alias("active"),
        F.count_if(F.col("state") == "DELETED").alias("deleted"),
        *[F.sum(c).alias(c) for c in ("handovers", "echoes", "bytes_uplink", "bytes_downlink")],
    )


def volume_by_direction(packets: DataFrame, tunnel: str, direction: str, size: str) -> DataFrame:
    """Packets and bytes up and down per tunnel in one row."""
    up, down = F.col(direction) == "UPLINK", F.col(direction) == "DOWNLINK"
    return packets.groupBy(tunnel).agg(
        F.count_if(up).alias("packets_uplink"),
        F.count_if(down).alias("packets_downlink"),
        F.sum(F.when(up, F.col(size)).otherwise(0)).alias("bytes_uplink"),
        F.sum(F.when(down, F.col(size)).otherwise(0)).alias("bytes_downlink"),
    )
