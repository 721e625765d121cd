"""Ordered-sequence values (previous row, last known value, running totals) that survive a hot key.

A plain ``Window.partitionBy(key)`` puts a key's whole history into one task. Here the history is cut into
slabs of the ordering axis, so the sort and the window run per (key, slab); what a slab needs from earlier ones
is one carried row per slab:

1. window functions inside (key, slab);
2. the last row of every slab hands its totals on; a window per key runs over those slab rows only;
3. an equi-join of that carry back on (key, slab) - the rows are already partitioned that way.

The largest unit of work is the rows of one key within one slab, plus the slab rows (not message rows) of one
key. The slab width is fitted to the heaviest key by :func:`fit_slab` unless given. Steps 1 and 2 read the same exchange, so Spark
shuffles the rows once when the frame holds no columns beyond those the walk needs: project before a chain of
walks, and each link is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import axis, interval_seconds

#: An interval text for a time axis, a width in axis units (microseconds for a time), or None to have it fitted.
Slab = str | int | None

#: Most rows of one key that should share a slab.
ROWS_PER_SLAB = 2_000_000


def fit_slab(df: DataFrame, by: Sequence[str], order: str, rows_per_slab: int | None = None) -> int:
    """Width that keeps the heaviest (key, slab) at or under ``rows_per_slab`` rows.

    One map-side combined count per key, with a single row coming back. Only when some key is too heavy are slabs
    counted too, narrower each time, down to a single instant.
    """
    most = ROWS_PER_SLAB if rows_per_slab is None else rows_per_slab
    placed = df.select(*by, axis(df, order).alias("_at")).filter(F.col("_at").isNotNull())
    per_key = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    heaviest, low, high = per_key.agg(F.max("_n"), F.min("_lo"), F.max("_hi")).first()
    if heaviest is None:
        return 1
    width = high - low + 1
    while heaviest > most and width > 1:
        width = max(1, width // max(2, -(-2 * heaviest // most)))
        slab = F.floor(F.col("_at") / F.lit(width))
        per_slab = placed.groupBy(*by, slab.alias("_slab")).agg(F.count(F.lit(1)).alias("_n"))
        heaviest = per_slab.agg(F.max("_n")).first()[0]
    return width


def width_of(slab: str | int) -> int:
    """Slab width in axis units."""
    return slab if isinstance(slab, int) else interval_seconds(slab) * 1_000_000


def slab_of(df: DataFrame, order: str, slab: str | int) -> Column:
    """Slab number of a row."""
    return F.floor(axis(df, order) / F.lit(width_of(slab))).cast("bigint")


@dataclass(frozen=True)
class Carried:
    """One value to carry along a timeline; build with the functions below."""

    kind: str
    value: Column
    inclusive: bool = True


def previous(value: Column) -> Carried:
    """``value`` of the row just before, NULL on the first row."""
    return Carried("previous", value, False)


def following(value: Column) -> Carried:
    """``value`` of the row just after, NULL on the last row; in one walk with what looks back."""
    return Carried("following", value, False)


def rows_after() -> Carried:
    """Number of later rows."""
    return Carried("after", F.lit(1).cast("bigint"), False)


def last_known(value: Column, inclusive: bool = False) -> Carried:
    """Latest non-NULL ``value`` on earlier rows (and this one when ``inclusive``)."""
    return Carried("last", value, inclusive)


def running(kind: str, value: Column, inclusive: bool = True) -> Carried:
    """Running ``sum``, ``min`` or ``max``; a sum starts from 0."""
    if kind not in ("sum", "min", "max"):
        raise ValueError(f"no running {kind}")
    return Carried(kind, value, inclusive)


def row_number() -> Carried:
    return Carried("sum", F.lit(1).cast("bigint"), True)


def _operand(spec: Carried) -> Column:
    """The column that the windows read; wrapped where a NULL value must differ from a missing row."""
    if spec.kind in ("previous", "following"):
        return F.struct(spec.value.alias("v"))
    if spec.kind == "last":
        return F.when(spec.value.isNotNull(), F.struct(spec.value.alias("v")))
    return spec.value


def _local(spec: Carried, name: str, ordered) -> Column:
    """The value as far as the row's own slab can tell."""
    if spec.kind == "previous":
        return F.lag(name).over(ordered)
    if spec.kind == "following":
        return F.lead(name).over(ordered)
    if spec.kind == "after":
        return _still_to_come(name, ordered)
    return _aggregate(spec, name, Window.currentRow if spec.inclusive else -1, ordered)


def _handed_on(spec: Carried, name: str, ordered) -> Column:
    """What a slab hands to the next ones, read off its last row."""
    if spec.kind == "previous":
        return F.col(name)
    if spec.kind == "following":
        return F.first(name).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _aggregate(spec, name, Window.currentRow, ordered)


def _aggregate(spec: Carried, name: str, until: int, ordered) -> Column:
    frame = ordered.rowsBetween(Window.unboundedPreceding, until)
    if spec.kind == "last":
        return F.last(name, True).over(frame)
    return getattr(F, "sum" if spec.kind == "after" else spec.kind)(name).over(frame)


def _still_to_come(name: str, ordered) -> Column:
    """Total less the sum so far: a frame that ends at the last row and moves its start would be read again each row."""
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.sum(name).over(whole) - F.sum(name).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _across(spec: Carried, name: str, slabs) -> Column:
    """Combination of what all earlier slabs, or for values that look ahead the later ones, handed on."""
    if spec.kind == "previous":
        return F.lag(name).over(slabs)
    if spec.kind == "following":
        return F.lead(name).over(slabs)
    if spec.kind == "after":
        return _still_to_come(name, slabs)
    before = slabs.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "last":
        return F.last(name, True).over(before)
    return getattr(F, spec.kind)(name).over(before)


def _combine(spec: Carried, local: Column, carry: Column) -> Column:
    if spec.kind in ("previous", "following", "last"):
        return F.coalesce(local, carry)["v"]
    if spec.kind in ("sum", "after"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return (F.least if spec.kind == "min" else F.greatest)(local, carry)


def carry_along(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slab: Slab = None,
    reverse: bool = False,
    keep_unplaced: bool = False,
    **values: Carried,
) -> DataFrame:
    """Add one column per ``values`` entry, computed along (``by``, ``order``).

    ``order[0]`` is the time or numeric axis that slabs cut; the rest break ties and must make the order total.
    ``reverse`` walks from the end (previous = next row). Rows with a NULL in ``by`` or ``order[0]`` belong to no
    timeline and are left out, or come back with NULL values (``keep_unplaced``). Without a ``slab`` the frame is counted first; fit one up front for a chain of walks.
    """
    by, order = list(by), list(order)
    slab = fit_slab(df, by, order[0]) if slab is None else slab
    slabbed = df.select(
        "*",
        slab_of(df, order[0], slab).alias("_slab"),
        *[_operand(spec).alias(f"_v_{name}") for name, spec in values.items()],
    )
    placed = reduce(and_, [F.col(key).isNotNull() for key in (*by, "_slab")])
    unplaced, slabbed = slabbed.filter(~placed), slabbed.filter(placed)
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    ordered = Window.partitionBy(*by, "_slab").orderBy(*ordering)
    walked = slabbed.select(
        "*",
        *[_local(spec, f"_v_{name}", ordered).alias(f"_l_{name}") for name, spec in values.items()],
        *[_handed_on(spec, f"_v_{name}", ordered).alias(f"_h_{name}") for name, spec in values.items()],
        F.lead(F.lit(True)).over(ordered).isNull().alias("_closes"),
    )
    slabs = Window.partitionBy(*by).orderBy(F.col("_slab").desc() if reverse else F.col("_slab"))
    carry = walked.filter("_closes").select(
        *by, "_slab", *[_across(spec, f"_h_{name}", slabs).alias(f"_k_{name}") for name, spec in values.items()]
    )
    kept = [c for c in df.columns if c not in values]
    found = walked.join(carry, [*by, "_slab"]).select(
        *kept,
        *[_combine(spec, F.col(f"_l_{name}"), F.col(f"_k_{name}")).alias(name) for name, spec in values.items()],
    )
    if not keep_unplaced:
        return found
    return found.unionByName(
        unplaced.select(*kept, *[F.lit(None).cast(found.schema[name].dataType).alias(name) for name in values])
    )
