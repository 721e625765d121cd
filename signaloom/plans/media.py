"""Media quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from .bindings import bound, check
from .registry import register

_CODEC = "CASE payload_type WHEN 0 THEN 'PCMU' WHEN 8 THEN 'PCMA' WHEN 18 THEN 'G729' WHEN 96 THEN 'AMR' WHEN 97 THEN 'AMR-WB' ELSE 'H264' END"
_CLOCK = "CASE payload_type WHEN 97 THEN 16000 WHEN 99 THEN 90000 ELSE 8000 END"
_QUALITY = f"""WITH w AS (SELECT *, lag(sequence_number) OVER o AS ps, lag(ts) OVER o AS pt, lag(rtp_timestamp) OVER o AS pr, {_CLOCK} AS clock,
    row_number() OVER (PARTITION BY ssrc ORDER BY ts DESC, frame_number DESC) AS back FROM rtp WINDOW o AS (PARTITION BY ssrc ORDER BY ts, frame_number)),
  t AS (SELECT *, CASE WHEN sequence_number - ps < -32768 THEN 1 WHEN sequence_number - ps > 32768 THEN -1 ELSE 0 END AS turn,
    abs((ts - pt) / 1000000.0 * clock - (rtp_timestamp - pr)) AS drift FROM w),
  x AS (SELECT *, sum(turn) OVER (PARTITION BY ssrc ORDER BY ts, frame_number) AS cycle FROM t),
  g AS (SELECT ssrc, count(*) AS packets_received, count(DISTINCT sequence_number + cycle * 65536) AS dist,
    CAST(max(sequence_number + cycle * 65536) - min(sequence_number + cycle * 65536) + 1 AS BIGINT) AS packets_expected, CAST(max(cycle) AS BIGINT) AS seq_cycles,
    count(*) FILTER (sequence_number < ps AND NOT (ps > 60000 AND sequence_number < 5000)) AS packets_out_of_order,
    coalesce(sum(drift * pow(15.0 / 16.0, back - 1)) / 16.0, 0) AS j, max(drift) AS md, min_by(payload_type, (ts, frame_number)) AS payload_type FROM x GROUP BY ssrc),
  q AS (SELECT *, greatest(packets_expected - dist, 0) AS packets_lost, packets_received - dist AS packets_duplicated, {_CODEC} AS codec,
    j * 1000.0 / {_CLOCK} AS jitter_ms, md * 1000.0 / {_CLOCK} AS max_jitter_ms FROM g),
  l AS (SELECT *, packets_lost * 1.0 / (packets_lost + packets_received) AS loss_rate FROM q),
  r AS (SELECT *, greatest(0, least(100, 93.2 - CASE WHEN jitter_ms > 20 THEN 0.024 * jitter_ms ELSE 0 END
      - CASE codec WHEN 'PCMU' THEN 0 WHEN 'PCMA' THEN 0 WHEN 'G729' THEN 11 WHEN 'AMR' THEN 5 WHEN 'AMR-WB' THEN 2 ELSE 5 END
      - CASE WHEN loss_rate <= 0 THEN 0 WHEN loss_rate * 100 < 5 THEN loss_rate * 250 ELSE (loss_rate * 100 - 5) * 5 + 10 END)) AS rr FROM l),
  s AS (SELECT ssrc, packets_received, packets_expected, seq_cycles, packets_out_of_order, packets_lost, packets_duplicated, codec, payload_type, loss_rate, jitter_ms, max_jitter_ms,
    greatest(1.0, least(5.0, 1.0 + 0.035 * rr + rr * (rr - 60) * (100 - rr) * 7e-6)) AS mos FROM r)"""


def _streams(spark, sf):
    return M.stream_quality(bound(spark, sf, "rtp"), ["ssrc"], ["ts", "frame_number"])


@register(
    "stream_quality",
    check(
        _QUALITY + """ SELECT * REPLACE (round(loss_rate, 9) AS loss_rate, round(jitter_ms, 3) AS jitter_ms, round(max_jitter_ms, 3) AS max_jitter_ms, round(mos, 6) AS mos) FROM s""",
        "rtp",
    ),
)
def _(spark, sf):
    digits = {"loss_rate": 9, "jitter_ms": 3, "max_jitter_ms": 3, "mos": 6}
    return _streams(spark, sf).withColumns({c: F.round(c, n) for c, n in digits.items()})


@register(
    "fleet_quality",
    check(
        _QUALITY + """ SELECT count(*) AS streams, round(avg(loss_rate), 9) AS avg_loss_rate, round(avg(jitter_ms), 2) AS avg_jitter_ms, round(avg(mos), 6) AS avg_mos,
        count(*) FILTER (mos < 3) AS poor_streams FROM s""",
        "rtp",
    ),
)
def _(spark, sf):
    digits = {"avg_loss_rate": 9, "avg_jitter_ms": 2, "avg_mos": 6}
    return M.fleet_quality(_streams(spark, sf)).withColumns({c: F.round(c, n) for c, n in digits.items()})


@register(
    "expected_packets",
    check(
        """WITH c AS (SELECT ssrc, count(*) AS received, max(frame_number) - min(frame_number) + 1 AS expected FROM rtp GROUP BY 1)
        SELECT *, greatest(expected - received, 0) AS lost, round(greatest(expected - received, 0) / expected, 9) AS loss_ratio FROM c""",
        "rtp",
    ),
)
def _(spark, sf):
    found = M.expected_by_range(bound(spark, sf, "rtp"), ["ssrc"], F.col("frame_number"))
    return found.withColumn("loss_ratio", F.round("loss_ratio", 9))
