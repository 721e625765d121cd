"""Row filters: rule lists, session and call filters, identifier lookups, paging."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPERATORS = {
    "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le,
}


def rule_parts(rule: str) -> tuple[str, str, str]:
    """(field, operator sign, value text), cut at the first sign; a text that is no rule is refused."""
    at, length = min(((rule.find(sign), -len(sign)) for sign in _OPERATORS if sign in rule), default=(0, 0))
    name, sign, value = rule[:at].strip(), rule[at : at - length], rule[at - length :].strip()
    if not value or not name or not all(c.isalnum() or c in "._" for c in name):
        raise ValueError(f"not a rule: {rule!r}")
    return name, sign, value


def rule_value(text: str) -> int | float | bool | str:
    """Integer of 64 bits, else decimal, else true/false, else a text with its quotes removed."""
    if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if "_" not in text:  # a digit separator in Python, not in a rule
        try:
            return float(text)
        except ValueError:
            pass
    if text in ("true", "TRUE", "false", "FALSE"):
        return text.lower() == "true"
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] == '"' else text


def _same_kind(value: int | float | bool | str, field: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(field, T.BooleanType)
    if isinstance(value, int):
        return isinstance(field, T.IntegralType)
    if isinstance(value, float):
        return isinstance(field, T.FractionalType)
    return isinstance(field, T.StringType)


def rule_filter(rows: DataFrame, rules: Sequence[str], fields: dict[str, str | Column] | None = None) -> DataFrame:
    """Rows that satisfy at least one ``field op value`` rule.

    ``fields`` names what a rule may refer to: a column name or any expression (default: the columns). A rule on an
    unknown field, of another type than its field, or on a NULL does not match; a text that is no rule is refused.
    """
    fields = {**{c: c for c in rows.columns}, **(fields or {})}
    tests = []
    for rule in rules:
        name, symbol, text = rule_parts(rule)
        value = rule_value(text)
        if name not in fields:
            continue
        field = fields[name] if isinstance(fields[name], Column) else F.col(fields[name])
        if _same_kind(value, rows.select(field.alias("f")).schema["f"].dataType):
            tests.append(F.coalesce(_OPERATORS[symbol](field, F.lit(value)), F.lit(False)))
    return rows.filter(reduce(operator.or_, tests, F.lit(False)))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """AND filter: a plain value means equality, a (low, high) pair a closed range with None for open ends."""
    for name, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, tuple):
            low, high = value
            rows = rows.filter(F.col(name) >= low) if low is not None else rows
            rows = rows.filter(F.col(name) <= high) if high is not None else rows
        else:
            rows = rows.filter(F.col(name) == value)
    return rows


def any_column(rows: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """Rows where one of ``columns`` holds ``value``: caller or callee, v4 or v6, either tunnel end."""
    return rows.filter(reduce(operator.or_, [F.coalesce(F.col(c) == value, F.lit(False)) for c in columns]))


def having_child(parents: DataFrame, children: DataFrame, on: str, condition: Column) -> DataFrame:
    """Parents with at least one child row that satisfies ``condition``."""
    return parents.join(children.filter(condition).select(on).distinct(), on, "left_semi")


def sessions_by_key(keys: DataFrame, wanted: DataFrame, session: str = "session_id") -> DataFrame:
    """Distinct sessions holding any of the ``wanted`` (key_type, key_value) rows."""
    return keys.join(wanted.distinct(), ["key_type", "key_value"]).select(*wanted.columns, session).distinct()


def messages_of_key(messages: DataFrame, keys: DataFrame, key_type: str, key_value: str, session: str, order: Sequence[str]):
    """All messages of the sessions holding one key, in time order."""
    hits = keys.filter((F.col("key_type") == key_type) & (F.col("key_value") == key_value)).select(session)
    return messages.join(hits, session, "left_semi").orderBy(*order)


#: Pages that begin at or beyond this row are found by rank.
FAR_ROWS = 100_000
#: Ranges of the sort column that are counted to find a page.
RANGES = 256


def page(
    rows: DataFrame, order: str, tie: str, number: int = 1, size: int = 20, descending: bool = True, far_rows: int = FAR_ROWS
) -> DataFrame:
    """One page of an ordered list, with the tie column ascending.

    A page near the top is a plain limit. Far down, rows are counted per range of the sort column, and only the ranges that the page
    lies in are sorted; where the page lies within a single value, the tie column is taken in ranges in turn.
    """
    skipped = (number - 1) * size
    if skipped >= far_rows:
        rows, skipped, alike = _ranges_of(rows, order, descending, skipped, size)
        if alike and skipped >= far_rows:
            rows, skipped, _ = _ranges_of(rows, tie, False, skipped, size)
    lead = F.col(order).desc() if descending else F.col(order).asc()
    return rows.orderBy(lead, F.col(tie).asc()).offset(skipped).limit(size)


def _ranges_of(rows: DataFrame, name: str, descending: bool, skipped: int, size: int) -> tuple[DataFrame, int, bool]:
    """The rows of the ranges that hold the places from ``skipped`` on, how many of those rows come before, and whether all are alike.

    A value that many rows have is a range of its own. Columns that are neither numbers nor times have no ranges: all rows stay.
    """
    kind = rows.schema[name].dataType
    if not isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
        return rows, skipped, False
    value = F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.DateType)) else F.col(name)
    held = rows.select(value.alias("v")).schema["v"].dataType.simpleString()
    shares = [k / RANGES for k in range(1, RANGES)]
    edges = rows.agg(F.percentile_approx(value, shares).alias("e")).first()["e"]
    edges = sorted(set(edges or []))
    # as the sort has it: nulls first when rising, last when falling
    marks = F.array(*[F.lit(e) for e in edges]).cast(f"array<{held}>")
    place = F.when(value.isNull(), -1).otherwise(2 * F.size(F.filter(marks, lambda e: e < value)) + F.array_contains(marks, value).cast("int"))
    counts = {r["_range"]: r["n"] for r in rows.groupBy(place.alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, ahead, passed = [], 0, 0
    for part in sorted(counts, reverse=descending):
        if passed + counts[part] <= skipped:
            ahead = passed + counts[part]
        elif passed < skipped + size:
            wanted.append(part)
        passed += counts[part]
    alike = len(wanted) == 1 and wanted[0] % 2 == 1
    return rows.filter(place.isin(wanted) if wanted else F.lit(False)), max(0, skipped - ahead), alike


def page_with_total(rows: DataFrame, order: str, tie: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page whose rows carry ``total``, the row count of the whole filtered list."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page(rows, order, tie, number, size).withColumn("total", total)


def uncorrelated(rows: DataFrame, claimed: DataFrame, on: str) -> DataFrame:
    """What no call claimed."""
    return rows.join(claimed.select(on), on, "left_anti")


def drop_older_jobs(
    jobs: DataFrame, sessions: DataFrame, events: DataFrame, created: str, cutoff: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retention: jobs created at or after ``cutoff`` with the sessions and events that still have a parent."""
    expired = jobs.filter(F.col(created) < cutoff)
    kept_sessions = sessions.join(expired.select("job_id"), "job_id", "left_anti")
    gone = sessions.join(expired.select("job_id"), "job_id", "left_semi").select("session_id")
    return (
        jobs.filter(F.col(created) >= cutoff),
        kept_sessions,
        events.join(gone, "session_id", "left_anti"),
    )
