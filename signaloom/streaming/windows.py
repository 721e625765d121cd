"""Windowed streams out of built-in operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Idle time that ends a flow, in seconds.
FLOW_IDLE_SECONDS = 300


def expired_flows(
    packets: DataFrame, ts: str, by: Sequence[str], length: str, idle_seconds: int = FLOW_IDLE_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """A record of each flow once it has been idle long enough."""
    session = F.session_window(ts, f"{idle_seconds} seconds")
    return (
        packets.withWatermark(ts, delay)
        .groupBy(session.alias("flow"), *by)
        .agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("packets"), F.sum(length).alias("bytes"))
        .drop("flow")
    )


def tumbling_counts(rows: DataFrame, ts: str, width: str, by: Sequence[str] = (), delay: str = "10 minutes", **measures: Column) -> DataFrame:
    """Counts per window, emitted when the window is closed."""
    return (
        rows.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()])
        .select(F.col("w.start").alias("bucket"), *by, "n", *measures)
    )


def without_repeats(rows: DataFrame, ts: str, signature: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """First row of each signature; a repeat within ``delay`` of it is dropped."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(signature))


def running_totals(rows: DataFrame, by: Sequence[str], **measures: Column) -> DataFrame:
    """Counts that grow with the stream; run in update or complete mode."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()])


def request_pairs(
    requests: DataFrame, answers: DataFrame, on: Sequence[str], request_id: str, requested: str, answered: str, timeout: str, delay: str = "10 minutes"
) -> DataFrame:
    """Each request with the time of its first answer, NULL when none came within ``timeout``; an outer join of two streams.

    Both streams have the columns ``on`` that an answer shares with its request. A request comes out once no answer can come in time any
    more; requests and answers with a NULL key meet nothing.
    """
    asked = requests.select(*on, request_id, requested).withWatermark(requested, delay)
    told = answers.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(answered).alias("_answered")).withWatermark("_answered", delay)
    same = " and ".join(f"{c} = _{c}" for c in on)
    in_time = f"_answered >= {requested} and _answered <= {requested} + interval {timeout}"
    met = asked.join(told, F.expr(f"{same} and {in_time}"), "leftOuter")
    return met.groupBy(*on, request_id, requested).agg(F.min("_answered").alias(answered))
