"""Procedure queries: step tables walked over whole message tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import procedures as P
from ..operators.timeline import fit_slab
from .bindings import bound, check
from .registry import register


def _folded(table: P.StepTable, source: str, by: str, trigger: str) -> str:
    """Check SQL of a walk: one recursion step per message of an entity, following the transition list."""
    moves = [(a, t, b) for a, t, b in table.steps]
    moves += [(end, table.start_trigger, table.steps[0][2]) for end in (*table.done, *table.failed)]
    rows = ", ".join(f"('{a}', '{t}', '{b}')" for a, t, b in moves)
    triggers = ", ".join(sorted({f"'{t}'" for _, t, _ in moves}))
    return f"""WITH mv(was, trg, becomes) AS (VALUES {rows}),
  r AS (SELECT {by}, ts, message_id, {trigger} AS trg, row_number() OVER (PARTITION BY {by} ORDER BY ts, message_id) AS n
    FROM {source} WHERE {trigger} IN ({triggers})),
  w AS (SELECT {by}, n, ts, message_id, trg, '{table.start}' AS was, (SELECT becomes FROM mv WHERE mv.was = '{table.start}' AND mv.trg = r.trg) AS becomes FROM r WHERE n = 1
    UNION ALL SELECT r.{by}, r.n, r.ts, r.message_id, r.trg, coalesce(w.becomes, w.was), mv.becomes FROM w JOIN r ON r.{by} = w.{by} AND r.n = w.n + 1
      LEFT JOIN mv ON mv.was = coalesce(w.becomes, w.was) AND mv.trg = r.trg),
  steps AS (SELECT {by}, ts, message_id, trg AS "trigger", was AS from_state, becomes AS to_state FROM w WHERE becomes IS NOT NULL),
  inst AS (SELECT *, CAST(sum(CASE WHEN "trigger" = '{table.start_trigger}' THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY ts, message_id) AS BIGINT) AS instance,
    CASE WHEN "trigger" <> '{table.start_trigger}' THEN (ts - lag(ts) OVER (PARTITION BY {by} ORDER BY ts, message_id)) // 1000 END AS since_previous_ms FROM steps)"""


def _instances(table: P.StepTable, by: str) -> str:
    """Check SQL of the per-instance roll-up, on top of :func:`_folded`."""
    timed = "".join(
        f""", (min(CASE WHEN "trigger" = '{b}' THEN ts END) - max(CASE WHEN "trigger" = '{a}' THEN ts END)) // 1000 AS {name}"""
        for name, (a, b) in table.durations.items()
    )
    listed = lambda names: ", ".join(f"'{n}'" for n in names) or "''"
    return f""", rolled AS (SELECT {by}, instance, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS steps, max_by(to_state, (ts, message_id)) AS state{timed},
      '{table.name}' AS procedure FROM inst GROUP BY {by}, instance),
    found AS (SELECT *, CASE WHEN state IN ({listed(table.done)}) THEN 'COMPLETE' WHEN state IN ({listed(table.failed)}) THEN 'FAILED' ELSE 'RUNNING' END AS outcome FROM rolled)"""


SHOPPING = P.StepTable(
    "SHOPPING",
    (
        ("IDLE", "signup", "SIGNED_UP"), ("SIGNED_UP", "view", "VIEWED"), ("VIEWED", "click", "CLICKED"),
        ("CLICKED", "purchase", "BOUGHT"), ("VIEWED", "error", "FAILED"), ("CLICKED", "error", "FAILED"),
    ),
    done=("BOUGHT",), failed=("FAILED",),
    durations={"signup_to_purchase": ("signup", "purchase"), "view_to_click": ("view", "click")},
)

ORDER = ["ts", "message_id"]


def _walk(spark, sf, table, trigger):
    rows = bound(spark, sf, "messages").select("user_id", *ORDER, trigger.alias("trg"))
    return _instances_of(rows, table)


def _instances_of(rows, table):
    slab = fit_slab(rows, ["user_id"], "ts")
    steps = P.walk_steps(rows, ["user_id"], ORDER, F.col("trg"), table, slab)
    return P.number_instances(steps, ["user_id"], ORDER, table, slab)


@register("step_records", check(_folded(SHOPPING, "messages", "user_id", "event_type") + " SELECT * FROM inst", "messages", recursive=True))
def _(spark, sf):
    return _walk(spark, sf, SHOPPING, F.col("event_type"))


@register(
    "procedures",
    check(_folded(SHOPPING, "messages", "user_id", "event_type") + _instances(SHOPPING, "user_id") + " SELECT * FROM found", "messages", recursive=True),
)
def _(spark, sf):
    return P.procedures(_walk(spark, sf, SHOPPING, F.col("event_type")), ["user_id"], ORDER, SHOPPING)


@register(
    "procedure_statistics",
    check(
        _folded(SHOPPING, "messages", "user_id", "event_type") + _instances(SHOPPING, "user_id")
        + """ SELECT procedure, count(*) AS total, count(*) FILTER (outcome = 'COMPLETE') AS complete, count(*) FILTER (outcome = 'FAILED') AS failed,
        count(*) FILTER (outcome = 'RUNNING') AS running FROM found GROUP BY procedure""",
        "messages", recursive=True,
    ),
)
def _(spark, sf):
    return P.procedure_statistics(P.procedures(_walk(spark, sf, SHOPPING, F.col("event_type")), ["user_id"], ORDER, SHOPPING))


def _trigger(table: P.StepTable) -> str:
    """Triggers dealt to messages so that whole procedures occur: mostly the step a user's message rank asks for."""
    names = list(dict.fromkeys(t for _, t, _ in table.steps))
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    return f"CASE (rank + CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END) % {len(names)} {cases} END"


def _ranked_sql(table: P.StepTable) -> str:
    return f"""ranked AS (SELECT user_id, ts, message_id, {_trigger(table)} AS trg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, message_id) - 1 AS rank FROM messages))"""


def _named_procedure(table: P.StepTable, met: bool = False):
    """Register the roll-up of one of the four named procedures."""
    folded = _folded(table, "ranked", "user_id", "trg")
    body = "WITH " + _ranked_sql(table) + ", " + folded[len("WITH "):] + _instances(table, "user_id")
    extra = f", handover_execution_time < {P.HANDOVER_TARGET_MS} AS interruption_time_met" if met else ""

    @register(table.name.lower(), check(f"{body} SELECT *{extra} FROM found", "messages", recursive=True))
    def _(spark, sf):
        from ..operators.pairing import sequence_in_leg

        rows = sequence_in_leg(bound(spark, sf, "messages").select("user_id", *ORDER, "k"), ["user_id"], ORDER, name="rank")
        rows = rows.withColumn("trg", F.expr(_trigger(table)))
        found = P.procedures(_instances_of(rows, table), ["user_id"], ORDER, table)
        return P.handover_target_met(found) if met else found


_named_procedure(P.LTE_ATTACH)
_named_procedure(P.X2_HANDOVER, met=True)
_named_procedure(P.VOLTE_CALL)
_named_procedure(P.FIVEG_REGISTRATION)


@register(
    "procedure_groups",
    check(
        """SELECT user_id, interface, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS total_events, (max(ts) - min(ts)) // 1000 AS duration_ms
        FROM messages WHERE protocol <> 'RTP' GROUP BY 1, 2""",
        "messages",
    ),
)
def _(spark, sf):
    rows = bound(spark, sf, "messages").withColumn("interface", F.expr("CASE WHEN protocol <> 'RTP' THEN interface END"))
    return P.procedure_groups(rows, "user_id", "interface", ORDER)


@register(
    "last_states",
    check(
        """SELECT user_id, CASE max_by(event_type, (ts, message_id)) WHEN 'signup' THEN 'CREATING' WHEN 'view' THEN 'ACTIVE' WHEN 'error' THEN 'DELETED' END AS state,
        max(ts) AS state_ts FROM messages WHERE event_type IN ('signup', 'view', 'error') GROUP BY 1""",
        "messages",
    ),
)
def _(spark, sf):
    state = F.expr("CASE event_type WHEN 'signup' THEN 'CREATING' WHEN 'view' THEN 'ACTIVE' WHEN 'error' THEN 'DELETED' END")
    return P.last_state(bound(spark, sf, "messages"), ["user_id"], ORDER, state)
