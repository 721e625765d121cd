"""SIP sessions, transactions and dialogs, call states and statistics."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import axis, millis
from ..functions.identifiers import uri_user
from .asof import earliest_claim
from .hubs import salted_join
from .procedures import StepTable, walk_steps
from .sessions import first_known
from .timeline import Slab, carry_along, fit_slab, running

# Session type by method of the first request (INVITE and REGISTER are refined below).
FIRST_METHOD = {
    "MESSAGE": "SMS_MESSAGE", "SUBSCRIBE": "SUBSCRIBE_NOTIFY", "NOTIFY": "SUBSCRIBE_NOTIFY", "OPTIONS": "OPTIONS",
    "REFER": "REFER", "INFO": "INFO",
}
EMERGENCY_URN = "urn:service:sos"
CALL_TYPES = ("VOICE_CALL", "VIDEO_CALL", "EMERGENCY_CALL")


def sip_sessions(messages: DataFrame, call_id: str, order: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """One row per Call-ID: span, type, parties, media and direction, all from map-side combined aggregates.

    ``also`` names columns whose first known value is wanted, in the same pass."""
    ts = order[0]
    request, invite = F.col("is_request"), F.col("is_request") & (F.col("method") == "INVITE")
    answer = ~F.col("is_request") & F.col("status_code").between(200, 299) & (F.col("cseq_method") == "INVITE")
    at = F.struct(*order)

    def first(value: str | Column, when: Column) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.min_by(value, F.when(when & value.isNotNull(), at))

    urgent = invite & (F.col("request_uri").contains(EMERGENCY_URN) | F.col("to_uri").contains(EMERGENCY_URN))
    offer = invite | answer
    rolled = messages.groupBy(call_id).agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("messages"),
        first("method", request).alias("first_method"),
        first("expires", request).alias("_expires"),
        F.coalesce(F.bool_or(urgent), F.lit(False)).alias("_urgent"),
        F.coalesce(F.bool_or(offer & F.col("has_audio")), F.lit(False)).alias("_audio"),
        F.coalesce(F.bool_or(offer & F.col("has_video")), F.lit(False)).alias("_video"),
        first(uri_user("from_uri"), request).alias("caller"),
        first(uri_user("to_uri"), request).alias("callee"),
        first("contact_ip", invite).alias("caller_ip"),
        first("contact_ip", answer).alias("callee_ip"),
        first("via_count", invite).alias("_via"),
        F.coalesce(F.bool_or(request & (F.col("method") == "BYE")), F.lit(False)).alias("completed"),
        *[first_known(c, order).alias(c) for c in also],
    )
    method = F.col("first_method")
    kind = (
        F.when((method == "REGISTER") & (F.col("_expires") == 0), "DEREGISTRATION")
        .when(method == "REGISTER", "REGISTRATION")
        .when((method == "INVITE") & F.col("_urgent"), "EMERGENCY_CALL")
        .when((method == "INVITE") & F.col("_audio") & F.col("_video"), "VIDEO_CALL")
        .when(method == "INVITE", "VOICE_CALL")
    )
    for name, value in FIRST_METHOD.items():
        kind = kind.when(method == name, value)
    direction = F.when(F.col("_via") > 2, "TERMINATING").otherwise("ORIGINATING")
    return (
        rolled.withColumn("session_type", kind.otherwise("UNKNOWN"))
        .withColumn("direction", direction)
        .drop("_expires", "_urgent", "_audio", "_video", "_via")
    )


def sip_statistics(sessions: DataFrame) -> DataFrame:
    kind = F.col("session_type")
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("messages").alias("total_messages"),
        F.count_if(kind.isin("REGISTRATION", "DEREGISTRATION")).alias("registrations"),
        F.count_if(kind == "VOICE_CALL").alias("voice_calls"),
        F.count_if(kind == "VIDEO_CALL").alias("video_calls"),
        F.count_if(kind == "SMS_MESSAGE").alias("sms"),
        F.count_if(~kind.isin("REGISTRATION", "DEREGISTRATION", "VOICE_CALL", "VIDEO_CALL", "SMS_MESSAGE")).alias("other"),
        F.count_if("completed").alias("completed"),
        F.count_if(~F.col("completed")).alias("active"),
    )


def sip_transactions(messages: DataFrame, branch: str, order: Sequence[str]) -> DataFrame:
    """Per Via branch: method, provisional codes seen, last final code, state, duration."""
    at, place = axis(messages, order[0]), F.struct(*order)
    response = ~F.col("is_request")
    final, provisional = response & (F.col("status_code") >= 200), response & F.col("status_code").between(100, 199)
    rolled = messages.groupBy(branch).agg(
        F.min_by("method", F.when(F.col("is_request"), place)).alias("method"),
        F.count_if(provisional).alias("provisional_responses"),
        F.array_join(F.array_sort(F.collect_set(F.when(provisional, F.col("status_code")))), ",").alias("provisional_codes"),
        F.max_by("status_code", F.when(final, place)).alias("final_code"),
        millis(F.max(at) - F.min(at)).alias("duration_ms"),
    )
    state = (
        F.when(F.col("final_code").isNotNull(), "COMPLETED")
        .when(F.col("provisional_responses") > 0, "PROCEEDING")
        .otherwise("TRYING")
    )
    return rolled.withColumn("state", state)


def sip_dialogs(messages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per (call id, from tag, to tag): early, confirmed, terminated; set-up time; number of forks.

    A message without a to-tag belongs to the dialog of the first tag that answered.
    """
    at = axis(messages, order[0])
    pair = ["call_id", "from_tag"]
    tagged = messages.withColumn("to_tag", F.when(F.col("to_tag") != "", F.col("to_tag")))
    first_tag = tagged.groupBy(*pair).agg(
        F.coalesce(first_known("to_tag", order), F.lit("")).alias("_first_tag"),
        F.greatest(F.count_distinct("to_tag") - 1, F.lit(0)).alias("forks"),
    )
    named = salted_join(tagged, first_tag, pair).withColumn("to_tag", F.coalesce("to_tag", "_first_tag"))
    confirmed = ~F.col("is_request") & F.col("status_code").between(200, 299) & (F.col("cseq_method") == "INVITE")
    ended = F.col("is_request") & (F.col("method") == "BYE")
    rolled = named.groupBy(*pair, "to_tag").agg(
        F.min(at).alias("_created"),
        F.min(F.when(confirmed, at)).alias("_confirmed"),
        F.min(F.when(ended, at)).alias("_ended"),
        F.count(F.lit(1)).alias("messages"),
        F.max("forks").alias("forks"),
    )
    state = (
        F.when(F.col("_ended").isNotNull(), "TERMINATED").when(F.col("_confirmed").isNotNull(), "CONFIRMED").otherwise("EARLY")
    )
    return rolled.select(
        *pair, "to_tag", state.alias("state"), millis(F.col("_confirmed") - F.col("_created")).alias("setup_ms"),
        "messages", "forks",
    )


def dialog_statistics(dialogs: DataFrame) -> DataFrame:
    return dialogs.groupBy("state").agg(
        F.count(F.lit(1)).alias("dialogs"), F.avg("setup_ms").alias("avg_setup_ms"), F.sum("forks").alias("forks")
    )


def call_kpis(messages: DataFrame, call_id: str, ts: str, any_method: bool = False) -> DataFrame:
    """Set-up, ring, answer and call time from the first INVITE, 180, 200 and BYE.

    The answer is the first 200 to an INVITE; ``any_method`` takes the first 200 of any method.
    """
    at, request = axis(messages, ts), F.col("is_request")
    answered = ~request & (F.col("status_code") == 200)
    if not any_method:
        answered = answered & (F.col("cseq_method") == "INVITE")
    first = lambda when: F.min(F.when(when, at))
    marks = messages.groupBy(call_id).agg(
        first(request & (F.col("method") == "INVITE")).alias("invite"),
        first(~request & (F.col("status_code") == 180)).alias("ringing"),
        first(answered).alias("ok"),
        first(request & (F.col("method") == "BYE")).alias("bye"),
    )
    return marks.select(
        call_id,
        millis(F.col("ok") - F.col("invite")).alias("setup_time_ms"),
        millis(F.col("ringing") - F.col("invite")).alias("ring_time_ms"),
        millis(F.col("ok") - F.col("ringing")).alias("answer_delay_ms"),
        millis(F.col("bye") - F.col("ok")).alias("call_duration_ms"),
    )


# Call states by event; an event other than INVITE and MEDIA acts from every state.
CALL_EVENTS = {
    "TRYING": "TRYING", "RINGING": "RINGING", "OK": "ANSWERED", "FAILURE": "FAILED", "ACK": "CONFIRMED",
    "BYE": "COMPLETED", "CANCEL": "CANCELLED",
}
_CALL_STATES = ("INITIATING", "MEDIA_ACTIVE", *CALL_EVENTS.values())
CALL_STATES = StepTable(
    "CALL_STATE",
    (
        ("IDLE", "INVITE", "INITIATING"),
        *((state, event, target) for state in _CALL_STATES for event, target in CALL_EVENTS.items()),
        ("CONFIRMED", "MEDIA", "MEDIA_ACTIVE"),
    ),
    done=(),
)


def call_event() -> Column:
    """Event name of a SIP message row; a row with protocol RTP is MEDIA."""
    request, status = F.col("is_request"), F.col("status_code")
    return (
        F.when(F.col("protocol") == "RTP", "MEDIA")
        .when(request & F.col("method").isin("INVITE", "ACK", "BYE", "CANCEL"), F.col("method"))
        .when(~request & (status == 100), "TRYING")
        .when(~request & status.isin(180, 183), "RINGING")
        .when(~request & (status == 200), "OK")
        .when(~request & (status >= 300), "FAILURE")
    )


def call_states(messages: DataFrame, call_id: str, order: Sequence[str], event: Column, slab: Slab = None) -> DataFrame:
    """State of every call at the end of the stream; a call exists from its INVITE on."""
    steps = walk_steps(messages, [call_id], order, event, CALL_STATES, slab)
    return steps.groupBy(call_id).agg(
        F.max_by("to_state", F.struct(*order)).alias("state"),
        F.min(order[0]).alias("start_ts"),
        F.max(order[0]).alias("state_ts"),
    )


def call_statistics(calls: DataFrame) -> DataFrame:
    """Calls by outcome, mean set-up over calls that have one, mean rating."""
    state = F.col("state")
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(state == "COMPLETED").alias("successful_calls"),
        F.count_if(state.isin("FAILED", "CANCELLED")).alias("failed_calls"),
        F.count_if(~state.isin("COMPLETED", "FAILED", "CANCELLED")).alias("active_calls"),
        F.avg(F.when(F.col("setup_time_ms") > 0, F.col("setup_time_ms"))).alias("avg_setup_time_ms"),
        F.avg(F.when(F.col("mos") > 0, F.col("mos"))).alias("avg_mos"),
    )


# How far before and after a call a leg of each kind may begin, in seconds.
LEG_TOLERANCE = {"Gx": 5, "Rx": 2, "Cx": 30, "Sh": 30, "GTP": 3, "NAS": 3, "RTP": 0}


def attach_by_icid_or_subscriber(
    messages: DataFrame, calls: DataFrame, message_id: str, ts: str, slab: Slab = None
) -> DataFrame:
    """(message id, call_id, ``how``): by charging id, else the subscriber's first call open at that time."""
    first_of_icid = calls.filter("icid is not null").groupBy("icid").agg(F.min("call_id").alias("call_id"))
    charged = messages.filter("icid is not null").select(message_id, "icid")
    by_icid = salted_join(charged, first_of_icid, ["icid"]).select(message_id, "call_id", F.lit("ICID").alias("how"))
    rest = messages.filter("imsi is not null").join(by_icid.select(message_id), message_id, "left_anti")
    open_ = earliest_claim(
        rest.select(message_id, "imsi", ts), calls.select("imsi", "call_id", "start_ts", "end_ts"), ["imsi"],
        message_id, ts, ts, "call_id", "start_ts", "end_ts", 0, slab,
    )
    return by_icid.unionByName(open_.withColumn("how", F.lit("SUBSCRIBER")))


def call_times(messages: DataFrame, call_id: str, ts: str) -> DataFrame:
    """(call_id, ``invite_ts, trying_ts, ringing_ts, answer_ts, ack_ts, bye_ts``): when a call's signalling first showed each."""
    request, status = F.col("is_request"), F.col("status_code")
    shown = {
        "invite_ts": request & (F.col("method") == "INVITE"), "trying_ts": ~request & (status == 100), "ringing_ts": ~request & (status == 180),
        "answer_ts": ~request & (status == 200) & (F.col("cseq_method") == "INVITE"),
        "ack_ts": request & (F.col("method") == "ACK"), "bye_ts": request & (F.col("method") == "BYE"),
    }
    return messages.groupBy(call_id).agg(*[F.min(F.when(when, F.col(ts))).alias(name) for name, when in shown.items()])


def attach_bearers(requests: DataFrame, calls: DataFrame, request_id: str, ts: str, slab: Slab = None) -> DataFrame:
    """(request id, ``call_id``): each bearer request with the first call of its subscriber, open at that time, that has no bearer yet.

    ``requests`` have ``imsi``, ``calls`` have ``imsi, call_id, start_ts, end_ts``. Requests are served in order of time, then id; a
    call is open from its start to its end, both included, and of the open ones the earliest start, then the lowest id, is
    the first. A request that finds none is left out, and so is one without a subscriber or a time.

    Which call is still free depends on every request before, so the queue is walked row by row, one stretch of calls that
    overlap at a time: a subscriber's stretches go to different tasks, and a task holds only the calls open at once.
    """
    begin, end = axis(calls, "start_ts"), axis(calls, "end_ts")
    opened = calls.filter(begin <= end).select(
        "imsi", begin.alias("_at"), F.lit(0).alias("_side"), end.alias("_end"), "call_id", F.lit(None).cast(requests.schema[request_id].dataType).alias(request_id)
    )
    asked = requests.select(
        "imsi", axis(requests, ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_end"),
        F.lit(None).cast(calls.schema["call_id"].dataType).alias("call_id"), F.col(request_id),
    )
    lined = opened.unionByName(asked).filter("imsi is not null and _at is not null")
    order = ["_at", "_side", "call_id", request_id]
    slab = fit_slab(lined, ["imsi"], "_at") if slab is None else slab
    reached = carry_along(lined, ["imsi"], order, slab, _reach=running("max", F.col("_end"), inclusive=False))
    within = F.coalesce(F.col("_at") <= F.col("_reach"), F.lit(False))
    # a request outside any call can have none
    held = reached.filter((F.col("_side") == 0) | within).withColumn("_opens", (~within).cast("bigint"))
    stretches = carry_along(held, ["imsi"], order, slab, _stretch=running("sum", F.col("_opens"))).select("imsi", "_stretch", "_end", *order)
    dealt = stretches.repartition("imsi", "_stretch").sortWithinPartitions("imsi", "_stretch", *order)
    schema = f"{request_id} {requests.schema[request_id].dataType.simpleString()}, call_id {calls.schema['call_id'].dataType.simpleString()}"

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, deque()
        for batch in batches:
            served = []
            names = ("imsi", "_stretch", "_at", "_side", "_end", "call_id", request_id)
            for imsi, stretch, at, side, until, call, request in zip(*[batch[n] for n in names], strict=True):
                if (imsi, stretch) != current:
                    current, free = (imsi, stretch), deque()
                if side == 0:
                    free.append((until, call))
                    continue
                while free and free[0][0] < at:
                    free.popleft()
                if free:
                    served.append((request, free.popleft()[1]))
            yield pd.DataFrame(served, columns=[request_id, "call_id"])

    return dealt.mapInPandas(serve, schema)


def calls_of(calls: DataFrame, parties: Sequence[str], value: str, kind: str | None = None) -> DataFrame:
    """Calls whose caller or callee is ``value``, optionally of one type."""
    hit = F.array_contains(F.array_compact(F.array(*[F.col(p) for p in parties])), value)
    found = calls.filter(hit)
    return found if kind is None else found.filter(F.col("session_type") == kind)
