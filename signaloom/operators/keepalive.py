"""Keep-alive echoes folded into runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import axis, whole_div
from ..session import cut_lineage
from .pairing import latest_unanswered
from .timeline import Slab, carry_along, fit_slab, following, previous, running

# A run breaks when the interval changes by more than 20 %, or after an unanswered wait of three
# intervals (900 s when there is no interval yet).
INTERVAL_CHANGE = 0.20
TIMEOUT_INTERVALS = 3
TIMEOUT_SECONDS = 900


def echoes_with_flags(
    messages: DataFrame, tunnel: Sequence[str], order: Sequence[str], kind: Column, slab: Slab = None
) -> DataFrame:
    """Requests with ``interval_sec`` to the previous one, ``timed_out`` and ``breaks``.

    Every walk doubles the plan above it, so the narrow echo table is written down twice on the way.
    """
    ts = order[0]
    slab = fit_slab(messages, tunnel, ts) if slab is None else slab
    echoes = latest_unanswered(messages, tunnel, order, kind, slab)
    echoes = echoes.withColumn("_at", axis(echoes, ts))
    beside = carry_along(echoes, tunnel, order, slab, _before=previous(F.col("_at")), _next=following(F.col("_at")))
    seconds = whole_div(F.col("_at") - F.col("_before"), 1_000_000)
    spaced = cut_lineage(beside.withColumn("interval_sec", seconds).drop("_before"), "echoes")
    seen = carry_along(spaced, tunnel, order, slab, _last=previous(F.col("interval_sec")))
    wait = whole_div(F.col("_next") - F.col("_at"), 1_000_000)
    limit = F.when(F.col("interval_sec") > 0, F.col("interval_sec") * TIMEOUT_INTERVALS).otherwise(TIMEOUT_SECONDS)
    timed_out = F.coalesce(F.col("response_ts").isNull() & (wait > limit), F.lit(False))
    changed = (F.col("_last") > 0) & (
        F.abs(F.col("interval_sec") - F.col("_last")) > F.col("_last") * F.lit(INTERVAL_CHANGE)
    )
    edge = F.col("interval_sec").isNull() | F.col("_next").isNull()
    breaks = edge | timed_out | F.coalesce(changed, F.lit(False))
    flagged = seen.withColumn("timed_out", timed_out).withColumn("breaks", breaks)
    return cut_lineage(flagged.drop("_last", "_next", "_at"), "echoes")


def keepalive_runs(echoes: DataFrame, tunnel: Sequence[str], order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Islands between breaking echoes: start, end, echoes, mean interval, whether all were answered."""
    ts = order[0]
    marked = echoes.withColumn("_break", F.col("breaks").cast("bigint"))
    numbered = carry_along(marked, tunnel, order, slab, run=running("sum", F.col("_break")))
    return (
        numbered.filter(~F.col("breaks"))
        .groupBy(*tunnel, "run")
        .agg(
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
            F.count(F.lit(1)).alias("echoes"),
            whole_div(F.sum("interval_sec"), F.count(F.lit(1))).alias("avg_interval_sec"),
            F.bool_and(F.col("response_ts").isNotNull()).alias("all_successful"),
        )
    )


def echo_statistics(echoes: DataFrame, tunnel: Sequence[str], order: Sequence[str]) -> DataFrame:
    return echoes.groupBy(*tunnel).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count("response_ts").alias("responses"),
        F.count_if("timed_out").alias("timeouts"),
        F.max(order[0]).alias("last_request_ts"),
        F.max("response_ts").alias("last_response_ts"),
        F.coalesce(whole_div(F.sum("interval_sec"), F.nullif(F.count("interval_sec"), F.lit(0))), F.lit(0)).alias(
            "avg_interval_sec"
        ),
    )

