"""Small helpers shared by all expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once per row however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def blank_to_null(value: ColumnLike) -> Column:
    value = col(value)
    return F.when(value != "", value)


def axis(df: DataFrame, name: str) -> Column:
    """A BIGINT axis for ordering arithmetic: microseconds for a timestamp, the value itself for a number."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("bigint")


def micros_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.unix_micros(col(later)) - F.unix_micros(col(earlier))


def whole_div(value: ColumnLike, divisor: int | ColumnLike) -> Column:
    """Integer division that truncates toward zero (``div`` of SQL)."""
    divisor = F.lit(divisor) if isinstance(divisor, int) else col(divisor)
    return F.call_function("div", col(value), divisor)


def millis(micros: ColumnLike) -> Column:
    """Whole milliseconds out of microseconds, truncated."""
    return whole_div(micros, 1000)


def iso_millis(ts: ColumnLike) -> Column:
    """ISO-8601 text with milliseconds in UTC; needs the session zone UTC."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_millis(ts: ColumnLike) -> Column:
    return F.unix_millis(col(ts))


def share(part: ColumnLike, total: ColumnLike) -> Column:
    """Percentage, NULL-free: an empty total gives 0."""
    return F.when(col(total) > 0, col(part) * 100.0 / col(total)).otherwise(0.0)


_INTERVAL_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def interval_seconds(text: str) -> int:
    """``30s 5m 1h 1d 1w`` or bare seconds; an empty text or an unknown unit means one hour."""
    if not text:
        return 3600
    match = re.match(r"\s*(\d+)(.?)", text)
    if not match:
        raise ValueError(f"not an interval: {text!r}")
    number, unit = int(match.group(1)), match.group(2)
    if not unit:
        return number
    return number * _INTERVAL_UNITS[unit] if unit in _INTERVAL_UNITS else 3600
