"""Diagrams of SIP sessions and calls, bearers of calls, documents of jobs and SIP sessions on hand-made rows."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signaloom.operators import calls as C
from signaloom.operators import diagram as D
from signaloom.operators import procedures as P
from signaloom.sources import sinks as SK

BASE = datetime(2024, 1, 1)
SIP = "s string, ts timestamp, id int, src_ip string, src_port int, dst_ip string, dst_port int, method string, status_code int, reason string"


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def test_ends_of_a_sip_session_are_numbered_by_address_and_port(spark):
    rows = spark.createDataFrame(
        [
            ("a", at(0), 1, "10.0.0.9", 5060, "10.0.0.10", 40000, "INVITE", None, None),
            ("a", at(1), 2, "10.0.0.10", 40000, "10.0.0.9", 5060, None, 180, "Ringing"),
            ("a", at(1), 3, "10.0.0.10", 5061, "10.0.0.9", 5060, None, 486, None),
            ("a", at(2), 4, None, 5060, "10.0.0.9", None, None, None, "why"),
            ("b", at(0), 5, "2001:db8::1", 7, "2001:db8::1", 7, "BYE", None, None),
            (None, at(0), 6, "x", 1, "y", 2, "BYE", None, None),
            ("b", None, 7, "2001:db8::1", 7, "z", 2, "ACK", None, None),
        ],
        SIP,
    )
    people = D.sip_participants(rows, ["s"])
    assert sorted((r.s, r.participant, r.ip, r.port, r.label, r.kind) for r in people.collect()) == [
        ("a", "p0", "10.0.0.10", 5061, "SIP-10", "proxy"),
        ("a", "p1", "10.0.0.10", 40000, "UE-10", "endpoint"),
        ("a", "p2", "10.0.0.9", 5060, "SIP-9", "proxy"),
        ("b", "p0", "2001:db8::1", 7, "UE-2001:db8::1", "endpoint"),
        ("b", "p1", "z", 2, "UE-z", "endpoint"),
    ]
    shown = {r.id: (r.message_no, r.sender, r.receiver, r.message, r.label) for r in D.sip_rows(rows, people, ["s"], ["ts", "id"]).collect()}
    assert shown == {
        1: (0, "p2", "p1", "INVITE", "INVITE"), 2: (1, "p1", "p2", "180", "180 Ringing"), 3: (2, "p0", "p2", "486", "486"), 4: (3, None, None, "", "SIP"),
        5: (0, "p0", "p0", "BYE", "BYE"), 6: (None, None, None, "BYE", "BYE"), 7: (None, "p0", "p1", "ACK", "ACK"),
    }
    plain = D.sip_rows(rows.drop("reason").filter("id = 2"), people, ["s"], ["ts", "id"]).first()
    assert (plain.label, plain.message_no) == ("180", 0)
    assert D.sip_participants(rows.limit(0), ["s"]).count() == 0 and D.sip_rows(rows.limit(0), people, ["s"], ["ts", "id"]).count() == 0


def test_rows_of_a_call(spark):
    calls = spark.createDataFrame(
        [("c", at(0), at(3), at(1), at(1), "QCI=1", "+1"), ("silent", None, None, None, None, None, None)],
        "call_id string, invite_ts timestamp, bye_ts timestamp, bearer_request_ts timestamp, rx_request_ts timestamp, bearer_request_details string, msisdn string",
    )
    assert [tuple(r) for r in D.call_rows(calls, "call_id").orderBy("event_no").collect()] == [
        ("c", 1, at(0), "ue", "pcscf", "SIP", "INVITE", ""), ("c", 2, at(1), "pcscf", "pcrf", "DIAMETER Rx", "AAR", ""),
        ("c", 3, at(1), "pgw", "sgw", "GTP-C", "Create Bearer Request", "QCI=1"), ("c", 4, at(3), "ue", "pcscf", "SIP", "BYE", ""),
    ]
    cast = D.call_participants(calls, "call_id", "msisdn")
    assert cast.count() == 12 and {r.name for r in cast.filter("participant = 'ue'").collect()} == {"UE (+1)", "UE ()"}
    with pytest.raises(ValueError):
        D.call_rows(calls.select("call_id"), "call_id")


@pytest.mark.parametrize("slab", [None, 7_000_000])
def test_a_call_takes_one_bearer(spark, slab):
    rng = random.Random(5)
    calls = [(rng.choice(["u", "v", None]), f"c{i:03}", at(s := rng.randrange(400)), at(s + rng.choice([-1, 0, 5, 40]))) for i in range(120)]
    requests = [(rng.choice(["u", "v", "w", None]), i, at(rng.randrange(450)) if i % 40 else None) for i in range(200)]
    expected, taken = set(), set()
    for imsi, request, ts in sorted((r for r in requests if r[2] and r[0]), key=lambda r: (r[2], r[1])):
        open_ = sorted((start, call) for i, call, start, end in calls if i == imsi and start <= ts <= end and call not in taken)
        if open_:
            taken.add(open_[0][1])
            expected.add((request, open_[0][1]))
    found = C.attach_bearers(
        spark.createDataFrame(requests, "imsi string, request int, ts timestamp"),
        spark.createDataFrame(calls, "imsi string, call_id string, start_ts timestamp, end_ts timestamp"), "request", "ts", slab,
    )
    assert {(r.request, r.call_id) for r in found.collect()} == expected and len(expected) > 20


def test_documents_of_jobs(spark):
    jobs = spark.createDataFrame([(1, "completed"), (2, "failed")], "job int, status string")
    sessions = spark.createDataFrame([(1, k, 10 + k) for k in range(5)], "job int, no int, packets long")
    found = SK.job_documents(jobs, sessions, "job", ["no"], ["no", "packets"], "packets", sessions_per_document=2).collect()
    read = {(r.job, r.part): json.loads(r.document) for r in found}
    assert sorted(read) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert [s["no"] for p in range(3) for s in read[1, p]["sessions"]] == list(range(5))
    assert all(read[1, p]["summary"] == {"total_sessions": 5, "total_events": 60} and read[1, p]["status"] == "completed" for p in range(3))
    assert read[2, 0]["sessions"] == [] and read[2, 0]["summary"] == {"total_sessions": 0, "total_events": 0}


def test_documents_of_sip_sessions(spark):
    calls = spark.createDataFrame([("c", "VOICE_CALL", at(0), at(2), 3, "", "001")], "call_id string, session_type string, start_ts timestamp, end_ts timestamp, messages long, caller_imsi string, callee_imsi string")
    rows = spark.createDataFrame(
        [("c", at(0), 1, True, "INVITE", None), ("c", at(1), 2, False, None, 183), ("c", at(2), 3, False, None, 486)],
        "call_id string, ts timestamp, frame int, is_request boolean, method string, status_code int",
    )
    (found,) = SK.sip_documents(calls, rows, ["ts", "frame"]).collect()
    read = json.loads(found.document)
    assert (read["message_count"], read["imsi"], read["end_time"] - read["start_time"]) == (3, "001", 2000)
    assert [e["message_type"] for e in read["events"]] == ["INVITE", "183 Progress", "486"]


def test_a_walk_over_very_many_blocks_stays_linear(spark, monkeypatch):
    """One key, one slab and 50,000 blocks: copying a grown array per block would take 1.25 billion copies."""
    monkeypatch.setattr(P, "BLOCK", 4)
    triggers = [t for _, t, _ in P.VOLTE_CALL.steps]
    names, n = F.array(*map(F.lit, triggers)), 200_000
    moves = {(a, t): b for a, t, b in P.VOLTE_CALL.steps}
    moves.update({(end, P.VOLTE_CALL.start_trigger): P.VOLTE_CALL.steps[0][2] for end in (*P.VOLTE_CALL.done, *P.VOLTE_CALL.failed)})
    state, expected = P.VOLTE_CALL.start, 0
    for i in range(n):
        if (step := (state, triggers[i % len(triggers)])) in moves:
            state, expected = moves[step], expected + 1
    rows = spark.range(n).select(
        F.lit("hot").alias("key"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), "id", F.get(names, (F.col("id") % F.size(names)).cast("int")).alias("t")
    )
    begun = time.time()
    steps = P.walk_steps(rows, ["key"], ["ts", "id"], F.col("t"), P.VOLTE_CALL, n * 1000)
    assert steps.count() == expected and time.time() - begun < 120
