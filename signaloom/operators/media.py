"""RTP stream quality and the joins of media streams with calls and users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import axis
from ..functions.quality import clock_rate, codec_name, loss_rate, mos
from .asof import earliest_claim
from .hubs import salted_join
from .timeline import Slab, carry_along, fit_slab, previous, rows_after, running

# Sequence numbers wrap at 65536; the jitter estimate moves by 1/16 of each new difference.
SEQUENCE_SPACE = 65_536
JITTER_GAIN = 1.0 / 16.0


def stream_quality(packets: DataFrame, stream: Sequence[str], order: Sequence[str], slab: Slab = None) -> DataFrame:
    """Loss, duplicates, order, jitter and MOS of every stream.

    Needs ``sequence_number``, ``rtp_timestamp`` and ``payload_type``. The sequence is extended over wraps (a drop of
    more than half the space). The jitter estimate J += (|D| - J)/16 over a stream is a weighted sum of |D| with
    weight (15/16)^(packets after it)/16, so it needs the number of rows after, not a loop.
    """
    ts = order[0]
    narrow = packets.select(
        *stream, *order, F.col("sequence_number").alias("seq"), F.col("rtp_timestamp").alias("rtp"),
        F.col("payload_type").alias("pt"),
    ).withColumn("_at", axis(packets, ts))
    slab = fit_slab(narrow, stream, ts) if slab is None else slab
    keep = F.struct("seq", "rtp", F.col("_at").alias("at"))
    walked = carry_along(narrow, stream, order, slab, before=previous(keep))
    step = F.col("seq") - F.col("before.seq")
    half = SEQUENCE_SPACE // 2
    turn = F.when(step < -half, 1).when(step > half, -1).otherwise(0)
    clock = clock_rate("pt")
    moved = (F.col("_at") - F.col("before.at")) / 1_000_000.0
    drift = F.abs(moved * clock - (F.col("rtp") - F.col("before.rtp")))
    stepped = walked.select(
        *stream, *order, "seq", "pt",
        turn.cast("bigint").alias("turn"),
        drift.alias("drift"),
        F.coalesce((step < 0) & ~((F.col("before.seq") > 60000) & (F.col("seq") < 5000)), F.lit(False)).alias("late"),
    )
    placed = carry_along(stepped, stream, order, slab, cycle=running("sum", F.col("turn")), after=rows_after())
    weight = F.pow(F.lit(1.0 - JITTER_GAIN), F.col("after").cast("double")) * JITTER_GAIN
    extended = F.col("seq") + F.col("cycle") * SEQUENCE_SPACE
    rolled = placed.groupBy(*stream).agg(
        F.count(F.lit(1)).alias("packets_received"),
        F.count_distinct(extended).alias("_distinct"),
        (F.max(extended) - F.min(extended) + 1).alias("packets_expected"),
        F.max("cycle").alias("seq_cycles"),
        F.count_if("late").alias("packets_out_of_order"),
        F.coalesce(F.sum(F.col("drift") * weight), F.lit(0.0)).alias("_jitter"),
        F.coalesce(F.max("drift"), F.lit(0.0)).alias("_max_drift"),
        F.min_by("pt", F.struct(*order)).alias("payload_type"),
    )
    lost = F.greatest(F.col("packets_expected") - F.col("_distinct"), F.lit(0))
    quality = (
        rolled.withColumn("packets_lost", lost)
        .withColumn("packets_duplicated", F.col("packets_received") - F.col("_distinct"))
        .withColumn("codec", codec_name("payload_type"))
        .withColumn("loss_rate", loss_rate("packets_lost", "packets_received"))
        .withColumn("jitter_ms", F.col("_jitter") * 1000.0 / clock_rate("payload_type"))
        .withColumn("max_jitter_ms", F.col("_max_drift") * 1000.0 / clock_rate("payload_type"))
    )
    return quality.withColumn("mos", mos("loss_rate", "jitter_ms", "codec")).drop("_distinct", "_jitter", "_max_drift")


def expected_by_range(packets: DataFrame, stream: Sequence[str], extended: str) -> DataFrame:
    """Cross-check of the loss count: highest - lowest + 1 against received."""
    counted = packets.groupBy(*stream).agg(
        F.count(F.lit(1)).alias("received"), (F.max(extended) - F.min(extended) + 1).alias("expected")
    )
    lost = F.greatest(F.col("expected") - F.col("received"), F.lit(0))
    return counted.withColumn("lost", lost).withColumn("loss_ratio", lost / F.col("expected"))


def fleet_quality(streams: DataFrame, poor_below: float = 3.0) -> DataFrame:
    """Means over all streams and the number with a poor rating."""
    return streams.agg(
        F.count(F.lit(1)).alias("streams"),
        F.avg("loss_rate").alias("avg_loss_rate"),
        F.avg("jitter_ms").alias("avg_jitter_ms"),
        F.avg("mos").alias("avg_mos"),
        F.count_if(F.col("mos") < poor_below).alias("poor_streams"),
    )


def stream_direction(streams: DataFrame, media: DataFrame) -> DataFrame:
    """(``stream_id``, ``call_id``, ``direction``): the call whose media endpoints a stream connects.

    ``media`` has call_id, ue_ip, ue_port, net_ip, net_port, start_ts, end_ts; a stream matches on all four
    endpoint columns and overlapping time. From the user is UPLINK, to the user DOWNLINK. Endpoints that many
    calls used at the same time go to the earliest one, so busy endpoints do not multiply rows.
    """
    ends = ["src_ip", "src_port", "dst_ip", "dst_port"]
    sides = (("UPLINK", "ue", "net"), ("DOWNLINK", "net", "ue"))
    both = F.array(*[
        F.struct(
            F.col(f"{src}_ip").alias("src_ip"), F.col(f"{src}_port").alias("src_port"),
            F.col(f"{dst}_ip").alias("dst_ip"), F.col(f"{dst}_port").alias("dst_port"),
            F.struct("call_id", F.lit(direction).alias("direction")).alias("call"),
        )
        for direction, src, dst in sides
    ])
    calls = media.select("start_ts", "end_ts", F.inline(both))
    found = earliest_claim(streams, calls, ends, "stream_id", "start_ts", "end_ts", "call", "start_ts", "end_ts")
    return found.select("stream_id", "call.call_id", "call.direction")


def streams_of_address(streams: DataFrame, addresses: DataFrame) -> DataFrame:
    """(stream columns, ``address``, ``role``): streams that send from or receive at a listed address."""
    ends = streams.withColumn(
        "_end",
        F.explode(F.array(F.struct(F.col("src_ip").alias("address"), F.lit("SENDER").alias("role")),
                          F.struct(F.col("dst_ip").alias("address"), F.lit("RECEIVER").alias("role")))),
    ).select(*streams.columns, "_end.*")
    return salted_join(ends, addresses.select("address").distinct(), ["address"])


def streams_in_window(streams: DataFrame, start: Column, end: Column) -> DataFrame:
    return streams.filter((F.col("end_ts") >= start) & (F.col("start_ts") <= end))
