"""As-of and interval joins without nested loops, and without all pairs of a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import axis
from ..session import cut_lineage
from .timeline import Slab, carry_along, last_known, running, width_of


def asof_join(
    probes: DataFrame,
    claims: DataFrame,
    on: Sequence[str],
    probe_at: Column,
    claim_at: Column,
    claim_tie: str | Column,
    forward: bool = False,
    slab: Slab = None,
    name: str = "claim",
) -> DataFrame:
    """Every probe with the STRUCT of the nearest claim of its key at or before it (at or after: ``forward``).

    ``probe_at`` / ``claim_at`` are BIGINT positions (microseconds). Among claims at one position the highest
    ``claim_tie`` wins going back, the lowest going forward. Probes with a NULL key or position come back with
    NULL. One sorted pass over the union of both sides; a hot key is cut into slabs.
    """
    on = list(on)
    tie = claim_tie if isinstance(claim_tie, Column) else F.col(claim_tie)
    sign = -1 if forward else 1
    claim_fields, probe_fields = F.struct(*claims.columns), F.struct(*probes.columns)
    left = probes.select(
        *on,
        (probe_at * sign).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("bigint").alias("_tie"),
        probe_fields.alias("_probe"),
        F.lit(None).cast(claims.schema).alias("_claim"),
    )
    right = claims.select(
        *on,
        (claim_at * sign).alias("_at"),
        F.lit(0).alias("_side"),
        (tie.cast("bigint") * sign).alias("_tie"),
        F.lit(None).cast(probes.schema).alias("_probe"),
        claim_fields.alias("_claim"),
    )
    placed = reduce(and_, [F.col(c).isNotNull() for c in (*on, "_at")])
    lined = left.filter(placed).unionByName(right.filter(placed))
    walked = carry_along(
        lined,
        on,
        ["_at", "_side", "_tie"],
        None if slab is None else width_of(slab),
        _found=last_known(F.col("_claim"), inclusive=True),
    )
    matched = walked.filter("_side = 1").select("_probe.*", F.col("_found").alias(name))
    unplaced = left.filter(~placed).select("_probe.*", F.col("_claim").alias(name))
    return matched.unionByName(unplaced)


def first_by_precedence(
    probes: DataFrame,
    claims: DataFrame,
    probe_id: str,
    keys: Sequence[Column],
    probe_at: Column,
    claim_key: str,
    claim_at: Column,
    claim_tie: str,
    take: str,
    slab: Slab = None,
) -> DataFrame:
    """(``probe_id``, ``take``): value of the latest earlier claim, trying a probe's ``keys`` in order.

    The keys of a probe are exploded with their rank, matched in one as-of pass, and the best rank wins.
    """
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate(keys)])
    tries = (
        probes.select(probe_id, probe_at.alias("_probe_at"), F.explode(ranked).alias("_try"))
        .select(probe_id, "_probe_at", F.col("_try.rank").alias("_rank"), F.col("_try.key").alias(claim_key))
        .filter(F.col(claim_key).isNotNull())
    )
    slim = claims.select(claim_key, claim_at.alias("_claim_at"), claim_tie, take)
    found = asof_join(tries, slim, [claim_key], F.col("_probe_at"), F.col("_claim_at"), claim_tie, slab=slab)
    hit = F.col(f"claim.{take}")
    return found.filter(hit.isNotNull()).groupBy(probe_id).agg(F.min_by(hit, F.col("_rank")).alias(take))


def earliest_claim(
    legs: DataFrame,
    windows: DataFrame,
    on: Sequence[str],
    leg_id: str,
    leg_start: str,
    leg_end: str,
    window_id: str,
    window_start: str,
    window_end: str,
    tolerance_us: int | Column = 0,
    slab: Slab = None,
    rank: Column | None = None,
) -> DataFrame:
    """(``leg_id``, ``window_id``): each leg goes to the earliest-starting window that it touches.

    ``tolerance_us`` may be an expression over the leg, so legs of several kinds go in one pass. ``rank`` orders the
    candidates of a leg that is given once per key before their start does, so that a surer key wins.

    A leg touches a window of the same key when the window, widened by the tolerance on both sides, overlaps
    [leg_start, leg_end]. Ties on start go to the lowest window id; a leg with several keys takes the earliest of
    its candidates; a leg is claimed once.

    A window that starts later and ends no later than another of its key can never win, so those are dropped.
    What is left has rising ends, and the only candidate of a leg is the first window ending at or after
    (leg_start - tolerance): one forward as-of step instead of a range join.
    """
    on = list(on)
    spans = windows.select(
        *on, F.col(window_id).alias("_wid"), axis(windows, window_start).alias("_ws"), axis(windows, window_end).alias("_we")
    ).filter(F.col("_ws").isNotNull() & F.col("_we").isNotNull())
    # Windows are mostly roll-ups; the steps below read them several times.
    spans = cut_lineage(spans, "windows")
    reach = carry_along(spans, on, ["_ws", "_wid"], None if slab is None else width_of(slab), _before=running("max", F.col("_we"), inclusive=False))
    rising = reach.filter(F.col("_before").isNull() | (F.col("_we") > F.col("_before"))).drop("_before")
    slack = F.lit(tolerance_us) if isinstance(tolerance_us, int) else tolerance_us
    probes = legs.select(
        *on,
        F.col(leg_id).alias("_lid"),
        (axis(legs, leg_start) - slack).alias("_ls"),
        (axis(legs, leg_end) + slack).alias("_le"),
        (F.lit(0) if rank is None else rank).alias("_rank"),
    )
    # Ends rise strictly within a key, so a tie cannot happen there.
    found = asof_join(probes, rising, on, F.col("_ls"), F.col("_we"), F.lit(0), forward=True, slab=slab, name="_w")
    touching = found.filter(F.col("_w._ws") <= F.col("_le"))
    best = F.min(F.struct(F.col("_rank").alias("rank"), F.col("_w._ws").alias("ws"), F.col("_w._wid").alias("wid")))
    return touching.groupBy("_lid").agg(best.alias("_best")).select(
        F.col("_lid").alias(leg_id), F.col("_best.wid").alias(window_id)
    )


def claims_within(
    probes: DataFrame,
    claims: DataFrame,
    on: Sequence[str],
    probe_at: Column,
    claim_at: Column,
    claim_tie: str,
    ttl_us: int,
    slab: Slab = None,
    name: str = "claim",
) -> DataFrame:
    """As-of match that only counts while the claim is younger than ``ttl_us``."""
    stamped = claims.withColumn("_claimed_at", claim_at)
    timed = probes.withColumn("_probed_at", probe_at)
    found = asof_join(timed, stamped, on, F.col("_probed_at"), F.col("_claimed_at"), claim_tie, slab=slab, name=name)
    live = F.col("_probed_at") - F.col(f"{name}._claimed_at") <= ttl_us
    return found.withColumn(name, F.when(live, F.col(name))).drop("_probed_at")
