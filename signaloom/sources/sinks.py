"""Session documents, relational tables and metric files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hubs import salted_join
from ..operators.timeline import Slab, carry_along, row_number
from ..session import cut_lineage

#: Most events in one document; a longer session goes on in the next part.
EVENTS_PER_DOCUMENT = 1_000
#: Most sessions, or continuations of sessions, in one document of a master session.
PIECES_PER_DOCUMENT = 100
# The reasons that answers are shown with.
SIP_REASONS = {100: "Trying", 180: "Ringing", 183: "Progress", 200: "OK"}
#: A session of at least this many parts is spread over several tasks when its head is added.
HUB_PARTS = 10_000


def session_documents(
    sessions: DataFrame,
    messages: DataFrame,
    session: str,
    order: Sequence[str],
    event_columns: Sequence[str],
    events_per_document: int = EVENTS_PER_DOCUMENT,
    slab: Slab = None,
    name: str = "events",
) -> DataFrame:
    """(session, ``part``, ``document``): JSON of the session with its ordered events, under ``name``.

    A session of any length is written whole: its events are numbered along the timeline and grouped into parts of
    a fixed size, so no row ever holds more than one part.
    """
    narrow = messages.select(session, *order, *[c for c in event_columns if c not in order])
    numbered = carry_along(narrow, [session], order, slab, event_no=row_number())
    part = F.floor((F.col("event_no") - 1) / events_per_document).cast("bigint")
    event = F.struct("event_no", *event_columns)
    parts = numbered.withColumn("part", part).groupBy(session, "part").agg(
        F.array_sort(F.collect_list(event)).alias(name)
    )
    head = F.struct(*[c for c in sessions.columns if c != session])
    heads = sessions.select(session, head.alias("_head"))
    joined = salted_join(parts, heads, [session], hub_rows=HUB_PARTS)
    document = F.to_json(F.struct(F.col(session), "part", "_head.*", name))
    return joined.select(session, "part", document.alias("document"))


def job_documents(
    jobs: DataFrame,
    sessions: DataFrame,
    job: str,
    order: Sequence[str],
    columns: Sequence[str],
    packets: str,
    sessions_per_document: int = EVENTS_PER_DOCUMENT,
    slab: Slab = None,
) -> DataFrame:
    """(job, ``part``, ``document``): the result of a job as JSON, with its sessions in order and a summary of them all.

    The columns of ``jobs`` are the head of every part; ``summary`` counts all sessions and their events, here the sum of
    ``packets``. Many sessions go on in further parts. A job without sessions has one document, with none.
    """
    totals = sessions.groupBy(job).agg(F.count(F.lit(1)).alias("total_sessions"), F.coalesce(F.sum(packets), F.lit(0)).alias("total_events"))
    none = F.lit(0).cast("bigint")
    summary = F.struct(*[F.coalesce(c, none.cast(totals.schema[c].dataType)).alias(c) for c in ("total_sessions", "total_events")])
    heads = cut_lineage(jobs.join(totals, job, "left").select(*jobs.columns, summary.alias("summary")), "heads")
    parts = session_documents(heads, sessions, job, order, columns, sessions_per_document, slab, "sessions")
    idle = heads.filter("summary.total_sessions = 0")
    empty = F.to_json(F.struct(job, none.alias("part"), *[c for c in heads.columns if c != job], F.array().cast("array<string>").alias("sessions")))
    return parts.unionByName(idle.select(job, none.alias("part"), empty.alias("document")))


def sip_documents(
    calls: DataFrame, messages: DataFrame, order: Sequence[str], event_columns: Sequence[str] = (), events_per_document: int = EVENTS_PER_DOCUMENT, slab: Slab = None
) -> DataFrame:
    """(``call_id``, ``part``, ``document``): SIP sessions as JSON with their messages, for sessions that have SIP only.

    Times are milliseconds; ``messages`` of ``calls`` becomes ``message_count``, and ``imsi``, if the parties' are known, is the caller's, else the
    callee's. A message is named by its method, an answer by its code and reason.
    """
    millis = lambda c: F.unix_millis(F.col(c))
    kept = [c for c in calls.columns if c not in ("call_id", "start_ts", "end_ts", "messages")]
    heads = calls.select("call_id", *kept, millis("start_ts").alias("start_time"), millis("end_ts").alias("end_time"), F.col("messages").alias("message_count"))
    if {"caller_imsi", "callee_imsi"} <= set(calls.columns):
        heads = heads.withColumn("imsi", F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("caller_imsi", "callee_imsi")]))
    code = F.col("status_code").cast("string")
    reason = F.create_map(*[F.lit(x) for pair in SIP_REASONS.items() for x in pair])[F.col("status_code").cast("int")]
    named = F.when(F.col("is_request"), F.col("method")).otherwise(F.concat_ws(" ", code, reason))
    events = messages.select("call_id", *order, *[c for c in event_columns if c not in order], millis(order[0]).alias("timestamp"), named.alias("message_type"))
    return session_documents(heads, events, "call_id", order, ["timestamp", "message_type", *event_columns], events_per_document, slab)


def master_documents(
    heads: DataFrame,
    events: DataFrame,
    master: str,
    session: str,
    order: Sequence[str],
    event_columns: Sequence[str],
    events_per_piece: int = EVENTS_PER_DOCUMENT,
    pieces_per_document: int = PIECES_PER_DOCUMENT,
    slab: Slab = None,
) -> DataFrame:
    """(master, ``part``, ``document``): JSON of a master session with its sessions, each with its ordered events.

    Both levels have continuations: a long session goes on in its next piece, many pieces go on in the next part of the master. Pieces
    follow one another by their first event. ``events`` has one row per event of a master's session, ``heads`` one per master.
    """
    narrow = events.select(master, session, *order, *[c for c in event_columns if c not in order])
    numbered = carry_along(narrow, [master, session], order, slab, event_no=row_number())
    piece = F.floor((F.col("event_no") - 1) / events_per_piece).cast("bigint")
    pieces = numbered.withColumn("piece", piece).groupBy(master, session, "piece").agg(
        F.min(order[0]).alias("_first"), F.array_sort(F.collect_list(F.struct("event_no", *event_columns))).alias("events")
    )
    placed = carry_along(cut_lineage(pieces, "pieces"), [master], ["_first", session, "piece"], slab, _no=row_number())
    part = F.floor((F.col("_no") - 1) / pieces_per_document).cast("bigint")
    entry = F.struct("_no", F.struct(F.col(session), "piece", "events").alias("session"))
    parts = placed.withColumn("part", part).groupBy(master, "part").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["session"]).alias("sessions")
    )
    whole = heads.select(master, F.struct(*[c for c in heads.columns if c != master]).alias("_head"))
    joined = salted_join(parts, whole, [master], hub_rows=HUB_PARTS)
    document = F.to_json(F.struct(F.col(master), "part", "_head.*", "sessions"))
    return joined.select(master, "part", document.alias("document"))


def session_summaries(sessions: DataFrame) -> DataFrame:
    """One JSON text per session, without events."""
    return sessions.select(F.to_json(F.struct("*")).alias("document"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, id_column: str, partition: str | None = None) -> None:
    """Idempotent insert: rows whose id the table does not hold yet are appended, nothing is replaced."""
    fresh = rows.dropDuplicates([id_column])
    try:
        held = rows.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        # a null id is never held, so such rows are always appended
        fresh = fresh.join(held.select(id_column), id_column, "left_anti").select(*rows.columns)
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    """Text exposition, every metric family in one sorted run of one file."""
    lines.repartitionByRange("metric").sortWithinPartitions("metric", "part", "line").select("line").write.mode(
        "overwrite"
    ).text(path)
