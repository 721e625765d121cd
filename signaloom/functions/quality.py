"""Voice quality arithmetic and the codec table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnLike, col

# RTP payload type -> (codec, clock rate).
CODECS = {
    0: ("PCMU", 8000), 3: ("GSM", 8000), 4: ("G723", 8000), 5: ("DVI4-8000", 8000), 6: ("DVI4-16000", 16000),
    7: ("LPC", 8000), 8: ("PCMA", 8000), 9: ("G722", 8000), 10: ("L16-2", 44100), 11: ("L16", 44100),
    12: ("QCELP", 8000), 13: ("CN", 8000), 14: ("MPA", 90000), 15: ("G728", 8000), 16: ("DVI4-11025", 11025),
    17: ("DVI4-22050", 22050), 18: ("G729", 8000), 25: ("CelB", 90000), 26: ("JPEG", 90000), 28: ("nv", 90000),
    31: ("H261", 90000), 32: ("MPV", 90000), 33: ("MP2T", 90000), 34: ("H263", 90000), 96: ("AMR", 8000),
    97: ("AMR-WB", 16000), 98: ("AMR-WB", 16000), 99: ("H264", 90000), 100: ("VP8", 90000),
    101: ("telephone-event", 8000), 102: ("H264", 90000), 103: ("H265", 90000),
}
DEFAULT_CLOCK = 8000
DYNAMIC_RANGE = (96, 127)

# Codec impairment of the E-model; other codecs take the default.
CODEC_IMPAIRMENT = {"PCMU": 0.0, "PCMA": 0.0, "G729": 11.0, "G723": 15.0, "AMR": 5.0, "AMR-WB": 2.0}
DEFAULT_IMPAIRMENT = 5.0

# Rating without impairments; jitter in ms that does no harm and the loss of rating per ms of a larger one; percent
# of lost packets at which loss becomes heavy, and the loss of rating per percent below and above.
BEST_RATING = 93.2
HARMLESS_JITTER_MS = 20.0
JITTER_WEIGHT = 0.024
HEAVY_LOSS_PERCENT = 5.0
LIGHT_LOSS_WEIGHT = 2.5
HEAVY_LOSS_WEIGHT = 5.0
HEAVY_LOSS_BASE = 10.0


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def codec_name(payload_type: ColumnLike) -> Column:
    payload_type = col(payload_type).cast("int")
    named = _lookup({k: v[0] for k, v in CODECS.items()}, payload_type)
    unnamed = F.when(payload_type.between(*DYNAMIC_RANGE), "dynamic").otherwise("unknown")
    return F.coalesce(named, unnamed)


def clock_rate(payload_type: ColumnLike) -> Column:
    return F.coalesce(
        _lookup({k: v[1] for k, v in CODECS.items()}, col(payload_type).cast("int")), F.lit(DEFAULT_CLOCK)
    )


def r_factor(loss_rate: ColumnLike, jitter_ms: ColumnLike, codec: ColumnLike) -> Column:
    """E-model rating from loss (0..1), jitter and codec, clamped to 0..100."""
    percent = col(loss_rate) * 100.0
    delay = F.when(col(jitter_ms) > HARMLESS_JITTER_MS, col(jitter_ms) * JITTER_WEIGHT).otherwise(0.0)
    loss = (
        F.when(percent <= 0.0, 0.0)
        .when(percent < HEAVY_LOSS_PERCENT, percent * LIGHT_LOSS_WEIGHT)
        .otherwise((percent - HEAVY_LOSS_PERCENT) * HEAVY_LOSS_WEIGHT + HEAVY_LOSS_BASE)
    )
    codec_part = F.coalesce(_lookup(CODEC_IMPAIRMENT, col(codec)), F.lit(DEFAULT_IMPAIRMENT))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(BEST_RATING) - delay - codec_part - loss))


def mos_from_r(rating: ColumnLike) -> Column:
    r = col(rating)
    mos = F.lit(1.0) + r * 0.035 + r * (r - 60.0) * (F.lit(100.0) - r) * 7.0e-6
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), mos))


def mos(loss_rate: ColumnLike, jitter_ms: ColumnLike, codec: ColumnLike) -> Column:
    return mos_from_r(r_factor(loss_rate, jitter_ms, codec))


def loss_rate(lost: ColumnLike, received: ColumnLike) -> Column:
    lost, total = col(lost), col(lost) + col(received)
    return F.when(total > 0, lost / total).otherwise(0.0)
