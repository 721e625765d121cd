"""Requests with responses, gaps, repeats and running stream positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import axis, micros_between, millis, whole_div
from ..session import cut_lineage
from .timeline import Slab, carry_along, fit_slab, last_known, previous, row_number, running

REQUEST, RESPONSE = "REQ", "RESP"


def sequence_in_leg(
    messages: DataFrame, leg: Sequence[str], order: Sequence[str], slab: Slab = None, name: str = "sequence"
) -> DataFrame:
    """0-based position of each message inside its leg; NULL without a leg or a time."""
    return carry_along(messages, leg, order, slab, keep_unplaced=True, **{name: row_number()}).withColumn(name, F.col(name) - 1)


def inter_event_gaps(messages: DataFrame, by: Sequence[str], order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Adds ``gap_us``, the time since the previous event; NULL on the first, and without a key or a time."""
    ts = order[0]
    walked = carry_along(messages, by, order, slab, keep_unplaced=True, _before=previous(F.col(ts)))
    return walked.withColumn("gap_us", micros_between(ts, "_before")).drop("_before")


def gap_metrics(messages: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Events, total duration and average gap per group.

    The gaps of an ordered sequence add up to last - first, so the average needs no window at all. Whole
    microseconds first, then whole milliseconds.
    """
    span = F.max(axis(messages, ts)) - F.min(axis(messages, ts))
    count = F.count(F.lit(1))
    return messages.groupBy(*by).agg(
        count.alias("total_events"),
        millis(span).alias("total_duration_ms"),
        F.when(count > 1, millis(whole_div(span, F.greatest(count - 1, F.lit(1))))).otherwise(0).alias("avg_gap_ms"),
    )


def request_latency(
    messages: DataFrame, by: Sequence[str], order: Sequence[str], kind: Column, slab: Slab = None
) -> DataFrame:
    """Responses that answer a pending request, with their latency.

    The latest pending request is used up by the first response after it, so a response pairs exactly when the
    row before it (among requests and responses of the key) is a request.
    """
    ts = order[0]
    relevant = messages.withColumn("_kind", kind).filter(F.col("_kind").isin(REQUEST, RESPONSE))
    before = previous(F.struct(F.col("_kind").alias("kind"), F.col(ts).alias("ts")))
    walked = carry_along(relevant, by, order, slab, _before=before)
    return (
        walked.filter((F.col("_kind") == RESPONSE) & (F.col("_before.kind") == REQUEST))
        .withColumn("request_ts", F.col("_before.ts"))
        .withColumn("latency_us", micros_between(ts, "request_ts"))
        .drop("_before", "_kind")
    )


def transactions(
    messages: DataFrame, by: Sequence[str], order: Sequence[str], is_request: Column, slab: Slab = None
) -> DataFrame:
    """One row per request with its answer, if any: ``answer_ts``, ``latency_us``, ``complete``.

    Same rule seen from the request: it is answered when the next row of the key is an answer.
    """
    ts = order[0]
    marked = messages.withColumn("_req", is_request)
    after = previous(F.struct(F.col("_req").alias("req"), F.col(ts).alias("ts")))
    walked = carry_along(marked, by, order, slab, reverse=True, _after=after)
    return (
        walked.filter("_req")
        .withColumn("answer_ts", F.when(~F.col("_after.req"), F.col("_after.ts")))
        .withColumn("latency_us", micros_between("answer_ts", ts))
        .withColumn("complete", F.col("answer_ts").isNotNull())
        .drop("_req", "_after")
    )


def session_latency(pairs: DataFrame, session: str) -> DataFrame:
    """Completed pairs and mean latency per session out of :func:`transactions`."""
    return pairs.groupBy(session).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("complete").alias("completed_pairs"),
        F.avg("latency_us").alias("mean_latency_us"),
    )


def latest_unanswered(
    messages: DataFrame, by: Sequence[str], order: Sequence[str], kind: Column, slab: Slab = None
) -> DataFrame:
    """(by, order, ``response_ts``) of all requests; the response is the one that took the request while it was the
    most recent unanswered one.

    A stack match without a stack: with +1 for a request and -1 for a response, ``floor`` is the lowest level
    reached so far; a response that lowers it had nothing to answer. Requests and the responses taking them share
    a level above the floor and stand next to each other within it.
    """
    ts = order[0]
    signed = (
        messages.select(*by, *order, kind.alias("_kind"))
        .filter(F.col("_kind").isin(REQUEST, RESPONSE))
        .withColumn("_step", F.when(F.col("_kind") == REQUEST, 1).otherwise(-1).cast("bigint"))
    )
    slab = fit_slab(signed, by, ts) if slab is None else slab
    levelled = carry_along(signed, by, order, slab, _s=running("sum", F.col("_step")))
    lowest = F.least(F.col("_s"), F.lit(0))
    floored = carry_along(
        levelled, by, order, slab, _floor=running("min", lowest), _floor_before=running("min", lowest, inclusive=False)
    )
    floored = cut_lineage(floored, "floors")
    before = F.coalesce(F.col("_floor_before"), F.lit(0))
    stray = (F.col("_kind") == RESPONSE) & (F.col("_s") < before)
    level = F.when(F.col("_kind") == REQUEST, F.col("_s") - F.col("_floor")).otherwise(
        F.col("_s") + 1 - F.col("_floor")
    )
    stacked = floored.filter(~stray).withColumn("_level", level)
    after = previous(F.struct(F.col("_kind").alias("kind"), F.col(ts).alias("ts")))
    walked = carry_along(stacked, [*by, "_level"], order, slab, reverse=True, _after=after)
    return (
        walked.filter(F.col("_kind") == REQUEST)
        .withColumn("response_ts", F.when(F.col("_after.kind") == RESPONSE, F.col("_after.ts")))
        .drop("_kind", "_step", "_s", "_floor", "_floor_before", "_level", "_after")
    )


def near_duplicates(
    rows: DataFrame, signature: Sequence[str], order: Sequence[str], within_us: int = 1000, slab: Slab = None
) -> DataFrame:
    """Adds ``is_duplicate``: the same signature was seen no more than ``within_us`` before.

    A row with a NULL in its signature or time stays and is no duplicate.
    """
    ts = order[0]
    walked = carry_along(rows, signature, order, slab, keep_unplaced=True, _before=previous(F.col(ts)))
    gap = micros_between(ts, "_before")
    return walked.withColumn("is_duplicate", F.coalesce(gap <= within_us, F.lit(False))).drop("_before")


def payload_checksum(payload: str) -> Column:
    """SHA-256 of the whole payload; length is compared as well."""
    return F.sha2(F.col(payload), 256)


def stream_accounting(
    segments: DataFrame, stream: Sequence[str], order: Sequence[str], seq: str, length: str, slab: Slab = None
) -> DataFrame:
    """Segments, bytes, retransmissions, out-of-order arrivals and gaps per stream direction.

    ``seq`` is the unwrapped sequence number. The highest byte delivered before a segment decides: wholly below
    is a retransmission, beyond it leaves a gap, at it continues.
    """
    end = F.col(seq) + F.col(length)
    walked = carry_along(segments, stream, order, slab, _high=running("max", end, inclusive=False))
    known = F.col("_high").isNotNull()
    retransmitted = known & (end <= F.col("_high"))
    ahead = known & (F.col(seq) > F.col("_high"))
    fresh = F.when(known, F.greatest(F.lit(0), end - F.greatest(F.col(seq), F.col("_high")))).otherwise(F.col(length))
    return walked.groupBy(*stream).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(length).alias("bytes"),
        F.sum(fresh).alias("new_bytes"),
        F.count_if(retransmitted).alias("retransmissions"),
        F.count_if(ahead).alias("gaps"),
        F.sum(F.when(ahead, F.col(seq) - F.col("_high")).otherwise(0)).alias("gap_bytes"),
    )


def chunk_gaps(chunks: DataFrame, stream: Sequence[str], order: Sequence[str], tsn: str, slab: Slab = None) -> DataFrame:
    """Per stream: chunks whose number is not the previous one plus one."""
    walked = carry_along(chunks, stream, order, slab, _before=previous(F.col(tsn)))
    return walked.groupBy(*stream).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("_before").isNotNull() & (F.col(tsn) != F.col("_before") + 1)).alias("gaps"),
    )


def fragment_completeness(
    fragments: DataFrame, datagram: Sequence[str], offset: str, length: str, more: str, slab: Slab = None
) -> DataFrame:
    """Datagrams whose fragments run without a hole from 0 to the end of the last fragment."""
    end = F.col(offset) + F.col(length)
    # Overlapping or repeated fragments close a hole as well, so compare with the furthest end so far.
    unique = fragments.groupBy(*datagram, offset).agg(F.max(length).alias(length), F.min(more).alias(more))
    walked = carry_along(unique, datagram, [offset], slab, _end=running("max", end, inclusive=False))
    return walked.groupBy(*datagram).agg(
        F.count(F.lit(1)).alias("fragments"),
        F.max(end).alias("bytes"),
        (
            F.bool_and(F.coalesce(F.col("_end"), F.lit(0)) >= F.col(offset))
            & F.bool_or(~F.col(more))
            & (F.max(F.when(~F.col(more), end)) == F.max(end))
        ).alias("complete"),
    )


def with_last_known(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, slab: Slab = None
) -> DataFrame:
    """Forward-fill: ``value`` of this row or the latest earlier one that has it."""
    return carry_along(rows, by, order, slab, **{name: last_known(value, inclusive=True)})
