"""Ordered step matching: walk each entity's messages through a table of (state, trigger, next state)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import axis, millis
from .timeline import Slab, carry_along, fit_slab, previous, running, slab_of

#: Most events folded into one array.
BLOCK = 256
#: (state, item) -> next state
Step = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class StepTable:
    """Transitions in order of the procedure; the first one starts it.

    ``done`` and ``failed`` are end states; the start trigger opens a new instance from either. ``durations`` names
    (from trigger, to trigger) pairs.
    """

    name: str
    steps: tuple[tuple[str, str, str], ...]
    done: tuple[str, ...]
    failed: tuple[str, ...] = ()
    durations: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def start(self) -> str:
        return self.steps[0][0]

    @property
    def start_trigger(self) -> str:
        return self.steps[0][1]

    def states(self) -> list[str]:
        return list(dict.fromkeys(s for a, _, b in self.steps for s in (a, b)))

    def moves(self) -> dict[str, list[int | None]]:
        """Trigger -> next state number by current state number; None where the trigger is ignored."""
        states = self.states()
        moves: dict[str, list[int | None]] = {}
        restarts = [(end, self.start_trigger, self.steps[0][2]) for end in (*self.done, *self.failed)]
        for state, trigger, following in (*self.steps, *restarts):
            moves.setdefault(trigger, [None] * len(states))[states.index(state)] = states.index(following)
        return moves


# The four procedures' step tables.
LTE_ATTACH = StepTable(
    "LTE_ATTACH",
    (
        ("IDLE", "ATTACH_REQUEST", "ATTACH_REQUESTED"),
        ("ATTACH_REQUESTED", "AUTHENTICATION_REQUEST", "AUTHENTICATION_IN_PROGRESS"),
        ("AUTHENTICATION_IN_PROGRESS", "AUTHENTICATION_RESPONSE", "AUTHENTICATION_COMPLETE"),
        ("AUTHENTICATION_IN_PROGRESS", "AUTHENTICATION_FAILURE", "FAILED"),
        ("AUTHENTICATION_COMPLETE", "SECURITY_MODE_COMMAND", "SECURITY_MODE_IN_PROGRESS"),
        ("SECURITY_MODE_IN_PROGRESS", "SECURITY_MODE_COMPLETE", "SECURITY_MODE_COMPLETE"),
        ("SECURITY_MODE_COMPLETE", "CREATE_SESSION_REQUEST", "SESSION_CREATION_IN_PROGRESS"),
        ("SESSION_CREATION_IN_PROGRESS", "CREATE_SESSION_RESPONSE", "SESSION_CREATED"),
        ("SESSION_CREATED", "INITIAL_CONTEXT_SETUP_REQUEST", "CONTEXT_SETUP_IN_PROGRESS"),
        ("CONTEXT_SETUP_IN_PROGRESS", "ATTACH_ACCEPT", "ATTACH_ACCEPTED"),
        ("ATTACH_ACCEPTED", "ATTACH_COMPLETE", "ATTACHED"),
    ),
    done=("ATTACHED",),
    failed=("FAILED",),
    durations={
        "attach_request_to_auth_request": ("ATTACH_REQUEST", "AUTHENTICATION_REQUEST"),
        "auth_request_to_auth_response": ("AUTHENTICATION_REQUEST", "AUTHENTICATION_RESPONSE"),
        "auth_to_security_mode": ("AUTHENTICATION_RESPONSE", "SECURITY_MODE_COMMAND"),
        "security_mode_to_gtp_create": ("SECURITY_MODE_COMPLETE", "CREATE_SESSION_REQUEST"),
        "gtp_create_to_gtp_response": ("CREATE_SESSION_REQUEST", "CREATE_SESSION_RESPONSE"),
        "gtp_response_to_context_setup": ("CREATE_SESSION_RESPONSE", "INITIAL_CONTEXT_SETUP_REQUEST"),
        "context_setup_to_attach_accept": ("INITIAL_CONTEXT_SETUP_REQUEST", "ATTACH_ACCEPT"),
        "attach_accept_to_complete": ("ATTACH_ACCEPT", "ATTACH_COMPLETE"),
        "total_attach_time": ("ATTACH_REQUEST", "ATTACH_COMPLETE"),
    },
)
X2_HANDOVER = StepTable(
    "X2_HANDOVER",
    (
        ("IDLE", "HANDOVER_REQUEST", "HANDOVER_REQUESTED"),
        ("HANDOVER_REQUESTED", "HANDOVER_REQUEST_ACK", "HANDOVER_PREPARED"),
        ("HANDOVER_REQUESTED", "HANDOVER_CANCEL", "FAILED"),
        ("HANDOVER_PREPARED", "SN_STATUS_TRANSFER", "SN_STATUS_TRANSFERRED"),
        ("HANDOVER_PREPARED", "PATH_SWITCH_REQUEST", "PATH_SWITCH_REQUESTED"),
        ("SN_STATUS_TRANSFERRED", "PATH_SWITCH_REQUEST", "PATH_SWITCH_REQUESTED"),
        ("PATH_SWITCH_REQUESTED", "MODIFY_BEARER_REQUEST", "PATH_SWITCH_REQUESTED"),
        ("PATH_SWITCH_REQUESTED", "MODIFY_BEARER_RESPONSE", "BEARER_MODIFIED"),
        ("BEARER_MODIFIED", "PATH_SWITCH_REQUEST_ACK", "PATH_SWITCH_ACKNOWLEDGED"),
        ("PATH_SWITCH_ACKNOWLEDGED", "UE_CONTEXT_RELEASE", "CONTEXT_RELEASED"),
    ),
    done=("CONTEXT_RELEASED",),
    failed=("FAILED",),
    durations={
        "handover_preparation_time": ("HANDOVER_REQUEST", "HANDOVER_REQUEST_ACK"),
        "path_switch_to_bearer_modify": ("PATH_SWITCH_REQUEST", "MODIFY_BEARER_REQUEST"),
        "bearer_modify_latency": ("MODIFY_BEARER_REQUEST", "MODIFY_BEARER_RESPONSE"),
        "handover_execution_time": ("HANDOVER_REQUEST_ACK", "UE_CONTEXT_RELEASE"),
        "total_handover_time": ("HANDOVER_REQUEST", "UE_CONTEXT_RELEASE"),
    },
)
#: A handover keeps its target when it is executed within this many milliseconds.
HANDOVER_TARGET_MS = 30
VOLTE_CALL = StepTable(
    "VOLTE_CALL",
    (
        ("IDLE", "INVITE", "INVITE_SENT"),
        ("INVITE_SENT", "TRYING", "TRYING_RECEIVED"),
        ("INVITE_SENT", "AAR", "MEDIA_AUTHORIZATION_IN_PROGRESS"),
        ("TRYING_RECEIVED", "AAR", "MEDIA_AUTHORIZATION_IN_PROGRESS"),
        ("MEDIA_AUTHORIZATION_IN_PROGRESS", "AAA", "MEDIA_AUTHORIZED"),
        ("MEDIA_AUTHORIZED", "RAR", "POLICY_INSTALLATION_IN_PROGRESS"),
        ("POLICY_INSTALLATION_IN_PROGRESS", "RAA", "POLICY_INSTALLED"),
        ("POLICY_INSTALLED", "CREATE_BEARER_REQUEST", "BEARER_CREATION_IN_PROGRESS"),
        ("BEARER_CREATION_IN_PROGRESS", "CREATE_BEARER_RESPONSE", "BEARER_CREATED"),
        ("BEARER_CREATED", "RINGING", "RINGING"),
        ("RINGING", "OK", "CALL_CONNECTED"),
        ("RINGING", "BYE", "FAILED"),
        ("RINGING", "CANCEL", "FAILED"),
        ("CALL_CONNECTED", "ACK", "MEDIA_ACTIVE"),
        ("MEDIA_ACTIVE", "BYE", "CALL_RELEASED"),
    ),
    done=("CALL_RELEASED",),
    failed=("FAILED",),
    durations={
        "invite_to_trying": ("INVITE", "TRYING"),
        "media_authorization_time": ("AAR", "AAA"),
        "policy_installation_time": ("RAR", "RAA"),
        "dedicated_bearer_setup_time": ("CREATE_BEARER_REQUEST", "CREATE_BEARER_RESPONSE"),
        "post_dial_delay": ("INVITE", "RINGING"),
        "call_setup_time": ("INVITE", "OK"),
        "answer_to_media": ("OK", "ACK"),
    },
)
FIVEG_REGISTRATION = StepTable(
    "FIVEG_REGISTRATION",
    (
        ("IDLE", "REGISTRATION_REQUEST", "REGISTRATION_REQUESTED"),
        ("REGISTRATION_REQUESTED", "AUTHENTICATION_REQUEST", "AUTHENTICATION_IN_PROGRESS"),
        ("AUTHENTICATION_IN_PROGRESS", "AUTHENTICATION_RESPONSE", "AUTHENTICATION_COMPLETE"),
        ("AUTHENTICATION_COMPLETE", "SECURITY_MODE_COMMAND", "SECURITY_MODE_IN_PROGRESS"),
        ("SECURITY_MODE_IN_PROGRESS", "SECURITY_MODE_COMPLETE", "SECURITY_MODE_COMPLETE"),
        ("SECURITY_MODE_COMPLETE", "INITIAL_CONTEXT_SETUP_REQUEST", "CONTEXT_SETUP_IN_PROGRESS"),
        ("CONTEXT_SETUP_IN_PROGRESS", "REGISTRATION_ACCEPT", "REGISTRATION_ACCEPTED"),
        ("REGISTRATION_ACCEPTED", "REGISTRATION_COMPLETE", "REGISTERED"),
    ),
    done=("REGISTERED",),
    durations={"total_registration_time": ("REGISTRATION_REQUEST", "REGISTRATION_COMPLETE")},
)


def _step_of_part(state: Column, part: Column) -> Column:
    return F.element_at(part["moved"], state + 1)


def _moved(items: Column, identity: Column, step: Step) -> Column:
    """A sequence of items as one: state in -> state out."""
    return F.aggregate(items, identity, lambda acc, x: F.transform(acc, lambda s: step(s, x)))


def _states_before(items: Column, identity: Column, step: Step, first: Column) -> Column:
    """State before every item of an array.

    Arrays grow by copying in a fold, so the items are taken in stretches of about the root of their number: the stretches
    are composed, the state before each is found among them, and each is walked on its own.
    """
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    count = F.floor((F.size(items) + width - 1) / width).cast("int")
    stretches = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(items, (i - 1) * width + 1, width)))

    def walked(xs: Column, start: Column, then: Step) -> Column:
        seen = F.struct(start.cast("int").alias("state"), F.array().cast("array<int>").alias("seen"))
        grown = lambda acc, x: F.struct(then(acc["state"], x).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen"))
        return F.aggregate(xs, seen, grown)["seen"]

    wholes = F.transform(stretches, lambda xs: _moved(xs, identity, step))
    starts = walked(wholes, first, lambda state, whole: F.element_at(whole, state + 1))
    # zipped, so that the starts are computed once and not once per stretch
    paired = F.arrays_zip(stretches.alias("xs"), starts.alias("start"))
    return F.flatten(F.transform(paired, lambda p: walked(p["xs"], p["start"], step)))


def walk_steps(
    messages: DataFrame, by: Sequence[str], order: Sequence[str], trigger: Column, table: StepTable, slab: Slab = None
) -> DataFrame:
    """Every transition taken: order columns, ``trigger``, ``from_state``, ``to_state``.

    A message that the current state has no transition for is ignored. The states are few, so a stretch of
    messages acts as a small array "state in -> state out", and such arrays compose. Blocks of at most
    :data:`BLOCK` messages are folded, composed to slabs and slabs to entities; the start states then flow back
    down. No entity is ever held as one list of its messages.
    """
    by, order = list(by), list(order)
    states, moves = table.states(), table.moves()
    identity = F.array(*[F.lit(i) for i in range(len(states))])
    next_of = F.create_map(
        *[x for name, targets in moves.items()
          for x in (F.lit(name), F.array(*[F.lit(t).cast("int") for t in targets]))]
    )
    names = F.array(*[F.lit(s) for s in states])

    def target(state: Column, event: Column) -> Column:
        return F.element_at(next_of[event["trigger"]], state + 1)

    def step(state: Column, event: Column) -> Column:
        return F.coalesce(target(state, event), state)

    def starts(position: str, first: Column) -> Column:
        """(position, state) of every part, given the parts in order."""
        before = _states_before(F.col("parts"), identity, _step_of_part, first)
        return F.arrays_zip(F.col(f"parts.{position}").alias(position), before.alias("state"))

    relevant = messages.select(*by, *order, trigger.alias("trigger")).filter(F.col("trigger").isin(list(moves)))
    slab = fit_slab(relevant, by, order[0]) if slab is None else slab
    slabbed = relevant.withColumn("_slab", slab_of(relevant, order[0], slab))
    place = F.row_number().over(Window.partitionBy(*by, "_slab").orderBy(*order))
    blocks = (
        slabbed.withColumn("_block", F.floor((place - 1) / BLOCK).cast("bigint"))
        .groupBy(*by, "_slab", "_block")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "trigger"))).alias("events"))
        .withColumn(
            "moved",
            _moved(F.col("events"), identity, step),
        )
    )
    slabs = blocks.groupBy(*by, "_slab").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_block").alias("block"), "moved"))).alias("parts")
    ).withColumn("moved", _moved(F.col("parts"), identity, _step_of_part))
    entities = slabs.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_slab").alias("slab"), "moved"))).alias("parts")
    )
    slab_starts = entities.select(*by, F.explode(starts("slab", F.lit(0))).alias("_s")).select(
        *by, F.col("_s.slab").alias("_slab"), F.col("_s.state").alias("_state")
    )
    block_starts = (
        slabs.select(*by, "_slab", "parts").join(slab_starts, [*by, "_slab"])
        .select(*by, "_slab", F.explode(starts("block", F.col("_state"))).alias("_b"))
        .select(*by, "_slab", F.col("_b.block").alias("_block"), F.col("_b.state").alias("_state"))
    )
    walked = blocks.select(*by, "_slab", "_block", "events").join(block_starts, [*by, "_slab", "_block"])
    seen = F.arrays_zip("events", _states_before(F.col("events"), identity, step, F.col("_state")).alias("was"))
    each = walked.select(*by, F.explode(seen).alias("_e")).select(*by, "_e.events.*", F.col("_e.was").alias("_was"))
    taken = each.withColumn("_now", F.element_at(next_of[F.col("trigger")], F.col("_was") + 1)).filter("_now is not null")
    return taken.select(
        *by, *order, "trigger",
        F.element_at(names, F.col("_was") + 1).alias("from_state"),
        F.element_at(names, F.col("_now") + 1).alias("to_state"),
    )


def number_instances(steps: DataFrame, by: Sequence[str], order: Sequence[str], table: StepTable, slab: Slab = None):
    """Adds ``instance`` (1, 2, .. per entity) and ``since_previous_ms`` (NULL on an instance's first step).

    Pass the ``slab`` that the walk used: it fits its steps too, and saves counting them.
    """
    opening = F.col("trigger") == table.start_trigger
    walked = carry_along(
        steps, by, order, slab,
        instance=running("sum", opening.cast("bigint")),
        _before=previous(axis(steps, order[0])),
    )
    gap = millis(axis(walked, order[0]) - F.col("_before"))
    return walked.withColumn("since_previous_ms", F.when(F.col("trigger") != table.start_trigger, gap)).drop("_before")


def procedures(steps: DataFrame, by: Sequence[str], order: Sequence[str], table: StepTable) -> DataFrame:
    """One row per instance: span, steps, final state, complete / failed and the table's durations in ms."""
    at = axis(steps, order[0])
    first = lambda name: F.min(F.when(F.col("trigger") == name, at))
    last = lambda name: F.max(F.when(F.col("trigger") == name, at))
    rolled = steps.groupBy(*by, "instance").agg(
        F.min(order[0]).alias("start_ts"),
        F.max(order[0]).alias("end_ts"),
        F.count(F.lit(1)).alias("steps"),
        F.max_by("to_state", F.struct(*order)).alias("state"),
        *[millis(first(b) - last(a)).alias(name) for name, (a, b) in table.durations.items()],
    )
    return rolled.withColumn("procedure", F.lit(table.name)).withColumn(
        "outcome",
        F.when(F.col("state").isin(list(table.done)), "COMPLETE")
        .when(F.col("state").isin(list(table.failed)), "FAILED")
        .otherwise("RUNNING"),
    )


def handover_target_met(found: DataFrame) -> DataFrame:
    return found.withColumn("interruption_time_met", F.col("handover_execution_time") < HANDOVER_TARGET_MS)


def procedure_statistics(found: DataFrame) -> DataFrame:
    """Instances per procedure and outcome, one row per procedure."""
    return found.groupBy("procedure").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("COMPLETE", "FAILED", "RUNNING")],
    )


def procedure_groups(messages: DataFrame, session: str, procedure: str, order: Sequence[str]) -> DataFrame:
    """First and last event, count and duration per named procedure of a session."""
    at = axis(messages, order[0])
    return messages.filter(F.col(procedure).isNotNull()).groupBy(session, procedure).agg(
        F.min(order[0]).alias("start_ts"),
        F.max(order[0]).alias("end_ts"),
        F.count(F.lit(1)).alias("total_events"),
        millis(F.max(at) - F.min(at)).alias("duration_ms"),
    )


def last_state(messages: DataFrame, by: Sequence[str], order: Sequence[str], state: Column) -> DataFrame:
    """State at the end of the stream: the latest state-setting message decides."""
    set_ = messages.withColumn("_state", state).filter("_state is not null")
    return set_.groupBy(*by).agg(
        F.max_by("_state", F.struct(*order)).alias("state"), F.max(order[0]).alias("state_ts")
    )
