"""Counting reports: KPIs, shares, buckets, trends, top lists, totals, metric lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import axis, interval_seconds, share


def job_counts(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs by state; queued and running ones are active."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col(status) == "completed").alias("completed_jobs"),
        F.count_if(F.col(status) == "failed").alias("failed_jobs"),
        F.count_if(F.col(status).isin("queued", "running")).alias("active_jobs"),
    )


def session_counts(sessions: DataFrame, packets: str, size: str, duration: str) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.sum(packets), F.lit(0)).alias("total_packets"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.avg(duration).alias("avg_duration_ms"),
        (F.sum(packets) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("packets_per_session"),
    )


def summary_kpis(
    jobs: DataFrame,
    sessions: DataFrame,
    status: str,
    created: str,
    packets: str,
    size: str,
    duration: str,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One KPI row over an optional job date range; sessions count when their job is in the range."""
    in_range = jobs
    if start is not None:
        in_range = in_range.filter(F.col(created) >= start)
    if end is not None:
        in_range = in_range.filter(F.col(created) <= end)
    kept = sessions.join(in_range.select("job_id"), "job_id", "left_semi")
    volume = session_counts(kept, packets, size, duration).select(F.struct("*")).scalar()
    return job_counts(in_range, status).withColumn("_volume", volume).select("*", "_volume.*").drop("_volume")


def share_of_total(rows: DataFrame, by: str, count: Column | None = None) -> DataFrame:
    """Count per value and its percentage; ``by`` is a dimension of fixed small range (protocol, type).

    The window over the grouped counts sees one row per value, never the input rows.
    """
    grouped = rows.groupBy(by).agg((count if count is not None else F.count(F.lit(1))).alias("n"))
    return grouped.withColumn("percent", share("n", F.sum("n").over(Window.partitionBy())))


def protocol_statistics(rows: DataFrame, by: str, packets: str | Column, size: str | Column) -> DataFrame:
    """Sessions, packets, bytes and share of sessions per protocol."""
    grouped = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(packets).alias("packets"), F.sum(size).alias("bytes")
    )
    return grouped.withColumn("percent", share("sessions", F.sum("sessions").over(Window.partitionBy())))


def bucket(ts: Column, interval: str) -> Column:
    """Start of the time bucket in epoch seconds."""
    width = interval_seconds(interval)
    return (F.floor(F.unix_micros(ts) / F.lit(width * 1_000_000)) * width).cast("bigint")


def time_buckets(rows: DataFrame, ts: str, interval: str = "1h", **measures: Column) -> DataFrame:
    """Counts (and ``measures``) per time bucket."""
    return rows.groupBy(bucket(F.col(ts), interval).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()]
    )


# Trend range -> (range, bucket width).
TREND_PRESETS = {"1h": ("1h", "5m"), "24h": ("24h", "1h"), "7d": ("7d", "6h")}


def trend(rows: DataFrame, ts: str, until: Column, preset: str = "24h", **measures: Column) -> DataFrame:
    """Bucketed counts of the range that ends at ``until``."""
    span, width = TREND_PRESETS[preset]
    at = F.unix_micros(F.col(ts))
    start = F.unix_micros(until) - interval_seconds(span) * 1_000_000
    return time_buckets(rows.filter((at > start) & (at <= F.unix_micros(until))), ts, width, **measures)


def period_change(rows: DataFrame, ts: str, until: Column, span: str) -> DataFrame:
    """Rows in the last period and the one before, with the change in percent (100 out of nothing)."""
    width = interval_seconds(span) * 1_000_000
    age = F.unix_micros(until) - F.unix_micros(F.col(ts))
    counted = rows.agg(
        F.count_if((age >= 0) & (age < width)).alias("current"),
        F.count_if((age >= width) & (age < 2 * width)).alias("previous"),
    )
    change = (F.col("current") - F.col("previous")) * 100.0 / F.col("previous")
    return counted.withColumn(
        "change_percent",
        F.when(F.col("previous") > 0, change).when(F.col("current") > 0, 100.0).otherwise(0.0),
    )


def job_performance(jobs: DataFrame, status: str, started: str, completed: str, size: str) -> DataFrame:
    """Mean throughput (Mbit/s) and run time of completed jobs, with the number running and queued."""
    seconds = (axis(jobs, completed) - axis(jobs, started)) / 1_000_000.0
    done = F.col(status) == "completed"
    return jobs.agg(
        F.avg(F.when(done, F.col(size) * 8.0 / 1_000_000.0 / F.nullif(seconds, F.lit(0.0)))).alias("avg_throughput_mbps"),
        F.avg(F.when(done, seconds)).alias("avg_completion_sec"),
        F.count_if(F.col(status) == "running").alias("running_jobs"),
        F.count_if(F.col(status) == "queued").alias("queued_jobs"),
    )


def type_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def endpoints(packets: DataFrame, ends: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Source and destination of every packet as rows of one ``endpoint`` column."""
    return packets.select(F.explode(F.array(*[F.col(e) for e in ends])).alias("endpoint"), *keep)


def talkers(packets: DataFrame, ends: Sequence[str], session: str, size: str, within: Column | None = None) -> DataFrame:
    """Volume per endpoint, whether it sends or receives.

    One pass over the packets; sessions are folded per endpoint first, so that counting them needs no row for each packet.
    """
    packets = packets if within is None else packets.filter(within)
    folded = endpoints(packets, ends, [session, size]).groupBy("endpoint", session).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes")
    )
    return folded.groupBy("endpoint").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.count(session).alias("sessions"))


def top_talkers(packets: DataFrame, ends: Sequence[str], session: str, size: str, limit: int = 10, by: str = "packets", within: Column | None = None):
    """The ``limit`` busiest endpoints by packets or bytes."""
    return talkers(packets, ends, session, size, within).orderBy(F.col(by).desc(), "endpoint").limit(limit)


def totals(**tables: DataFrame) -> DataFrame:
    """(``table``, ``rows``) for each named table."""
    counted = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    first, *rest = counted
    for more in rest:
        first = first.unionByName(more)
    return first


def metric_lines(kpis: DataFrame, prefix: str, kinds: dict[str, str], labels: Sequence[str] = ()) -> DataFrame:
    """Text exposition of numeric columns, with the ``labels`` columns as labels.

    ``kinds`` maps a column to ``counter`` or ``gauge``. (``metric``, ``line``); the header line sorts first.
    """
    label = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in labels])
    braces = F.concat(F.lit("{"), label, F.lit("}")) if labels else F.lit("")
    lines = []
    for name, kind in kinds.items():
        metric = f"{prefix}_{name}"
        value = F.concat(F.lit(metric), braces, F.lit(" "), F.col(name).cast("string"))
        lines.append(F.struct(F.lit(metric).alias("metric"), F.lit(1).alias("part"), value.alias("line")))
    values = kpis.select(F.inline(F.array(*lines)))
    spark = kpis.sparkSession
    heads = spark.createDataFrame(
        [(f"{prefix}_{n}", 0, f"# TYPE {prefix}_{n} {k}") for n, k in kinds.items()], "metric string, part int, line string"
    )
    return heads.unionByName(values)


def interface_protocols(packets: DataFrame, interface: str, size: str, protocol: str) -> DataFrame:
    """Packets and bytes per capture interface and known protocol."""
    known = packets.filter(F.col(protocol) != "UNKNOWN")
    return known.groupBy(interface, protocol).agg(F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"))


def interface_ports(packets: DataFrame, interface: str, ports: Sequence[str]) -> DataFrame:
    """The ports seen on each capture interface: distinct (interface, ``port``), as rows because their number has no bound."""
    return packets.select(interface, F.explode(F.array(*ports)).alias("port")).filter("port is not null").distinct()


def interface_counters(
    packets: DataFrame, interface: str, size: str, protocol: str, ports: Sequence[str], drops: str | None = None
) -> DataFrame:
    """Per capture interface: packets, bytes, protocols, distinct ports, and the sum of ``drops`` where there is one."""
    each = packets.select(interface, F.explode(F.array(*ports)).alias("port"))
    lost = [F.sum(drops).alias("drops")] if drops else []
    volume = packets.groupBy(interface).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"), F.count_distinct(protocol).alias("protocols"), *lost
    )
    seen = each.groupBy(interface).agg(F.count_distinct("port").alias("ports"))
    return volume.join(seen, interface)
