"""Procedures, media, keep-alives, calls, handovers and diagrams on hand-made rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signaloom.functions import codes, core
from signaloom.operators import calls as C
from signaloom.operators import diagram as D
from signaloom.operators import filters as FI
from signaloom.operators import handover as H
from signaloom.operators import keepalive as K
from signaloom.operators import media as ME
from signaloom.operators import procedures as P
from signaloom.operators import sessions as S
from signaloom.operators import tunnels as T

BASE = datetime(2024, 1, 1)


def at(ms):
    return BASE + timedelta(milliseconds=ms)


@pytest.mark.parametrize("block,slab", [(4, 11), (256, 10_000)])
def test_walk_equals_a_loop(spark, monkeypatch, block, slab):
    monkeypatch.setattr(P, "BLOCK", block)
    table = P.VOLTE_CALL
    rng = random.Random(block)
    names = [t for _, t, _ in table.steps] + ["NOISE"]
    data = []
    for i in range(500):
        # Mostly the next expected trigger, so that procedures get far.
        data.append((rng.choice(["hot", "hot", "cold"]), i, i, names[(i // 2) % len(names)] if rng.random() < 0.7 else rng.choice(names)))
    moves = {(a, t): b for a, t, b in table.steps}
    moves.update({(end, "INVITE"): "INVITE_SENT" for end in (*table.done, *table.failed)})
    expected, state = set(), {}
    for key, t, i, name in data:
        now = state.get(key, "IDLE")
        if (now, name) in moves:
            state[key] = moves[now, name]
            expected.add((key, i, name, now, state[key]))
    df = spark.createDataFrame(data, "key string, t bigint, id bigint, name string")
    got = P.walk_steps(df, ["key"], ["t", "id"], F.col("name"), table, slab)
    assert {(r.key, r.id, r.trigger, r.from_state, r.to_state) for r in got.collect()} == expected
    assert len(expected) > 50


def test_attach_durations(spark):
    names = ["ATTACH_REQUEST", "AUTHENTICATION_REQUEST", "AUTHENTICATION_RESPONSE", "SECURITY_MODE_COMMAND", "SECURITY_MODE_COMPLETE",
             "CREATE_SESSION_REQUEST", "CREATE_SESSION_RESPONSE", "INITIAL_CONTEXT_SETUP_REQUEST", "ATTACH_ACCEPT", "ATTACH_COMPLETE"]
    rows = [("u", at(10 * i), i, n) for i, n in enumerate(names)] + [("v", at(0), 50, "ATTACH_REQUEST"), ("v", at(5), 51, "ATTACH_COMPLETE")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, name string")
    steps = P.number_instances(P.walk_steps(df, ["key"], ["ts", "id"], F.col("name"), P.LTE_ATTACH), ["key"], ["ts", "id"], P.LTE_ATTACH)
    found = {r.key: r for r in P.procedures(steps, ["key"], ["ts", "id"], P.LTE_ATTACH).collect()}
    assert found["u"].outcome == "COMPLETE" and found["u"].total_attach_time == 90 and found["u"].attach_accept_to_complete == 10
    # Out of order: the completion is ignored while the attach still waits for authentication.
    assert found["v"].outcome == "RUNNING" and found["v"].state == "ATTACH_REQUESTED" and found["v"].steps == 1


def rtp(rows, payload_type=0):
    return [(7, at(arrival * 1000), i, seq, ts, payload_type) for i, (arrival, seq, ts) in enumerate(rows)]


RTP = "ssrc bigint, ts timestamp, frame bigint, sequence_number int, rtp_timestamp bigint, payload_type int"


def quality(spark, rows, slab="1s", **kwargs):
    return ME.stream_quality(spark.createDataFrame(rtp(rows, **kwargs), RTP), ["ssrc"], ["ts", "frame"], slab).first()


def test_perfect_stream(spark):
    q = quality(spark, [(0.02 * i, 1000 + i, 8000 + 160 * i) for i in range(50)])
    assert (q.packets_received, q.packets_lost, q.packets_duplicated, q.codec) == (50, 0, 0, "PCMU")
    assert q.jitter_ms < 1 and q.mos > 4


def test_lost_packets(spark):
    q = quality(spark, [(0.02 * i, s, 160 * i) for i, s in enumerate([1000, 1001, 1003, 1006])])
    assert q.packets_lost == 3 and q.packets_expected == 7


def test_wrap_is_no_loss(spark):
    q = quality(spark, [(0.02 * i, s, 160 * i) for i, s in enumerate([65534, 65535, 0, 1])])
    assert (q.seq_cycles, q.packets_lost, q.packets_out_of_order) == (1, 0, 0)


def test_late_packet_across_the_wrap(spark):
    q = quality(spark, [(0.02 * i, s, 160 * i) for i, s in enumerate([65534, 0, 65535, 1, 1])])
    assert (q.packets_lost, q.packets_duplicated) == (0, 1)


def test_jitter_equals_recursion(spark):
    rng = random.Random(3)
    rows = [(0.02 * i + rng.random() * 0.01, i, 160 * i) for i in range(400)]
    estimate, top = 0.0, 0.0
    for before, now in zip(rows, rows[1:]):
        moved = round(now[0] * 1e6) / 1e6 - round(before[0] * 1e6) / 1e6
        drift = abs(moved * 8000 - (now[2] - before[2]))
        estimate += (drift - estimate) / 16
        top = max(top, drift)
    q = quality(spark, rows)
    assert q.jitter_ms == pytest.approx(estimate / 8, rel=1e-3) and q.max_jitter_ms == pytest.approx(top / 8, rel=1e-3)


def test_poor_stream(spark):
    q = quality(spark, [(0.02 * i, 3 * i, 160 * i) for i in range(50)])
    assert 1 <= q.mos < 3.5


ECHO = "teid bigint, ts timestamp, id bigint, kind string"


def echoes(spark, seconds, answer=True):
    rows = [(1, at(1000 * s), 2 * i, "REQ") for i, s in enumerate(seconds)]
    rows += [(1, at(1000 * s + 1000), 2 * i + 1, "RESP") for i, s in enumerate(seconds)] if answer else []
    return K.echoes_with_flags(spark.createDataFrame(rows, ECHO), ["teid"], ["ts", "id"], F.col("kind"), slab="1h")


def test_regular_echoes(spark):
    flagged = echoes(spark, [300 * i for i in range(100)])
    stats = K.echo_statistics(flagged, ["teid"], ["ts", "id"]).first()
    assert (stats.requests, stats.responses, stats.timeouts, stats.avg_interval_sec) == (100, 100, 0, 300)
    runs = K.keepalive_runs(flagged, ["teid"], ["ts", "id"], slab="1h").collect()
    assert [(r.echoes, r.avg_interval_sec, r.all_successful) for r in runs] == [(98, 300, True)]


def test_single_echo_and_interval_change(spark):
    assert K.echo_statistics(echoes(spark, [0], answer=False), ["teid"], ["ts", "id"]).first().responses == 0
    times = [300 * i for i in range(10)] + [2700 + 600 * (i + 1) for i in range(10)]
    assert K.keepalive_runs(echoes(spark, times), ["teid"], ["ts", "id"], slab="1h").count() > 1


def test_unanswered_echo_times_out(spark):
    rows = [(1, at(0), 1, "REQ"), (1, at(1_000_000), 2, "REQ"), (1, at(1_001_000), 3, "RESP")]
    flagged = K.echoes_with_flags(spark.createDataFrame(rows, ECHO), ["teid"], ["ts", "id"], F.col("kind"))
    assert [(r.id, r.timed_out) for r in flagged.orderBy("id").collect()] == [(1, True), (2, False)]


def test_handovers(spark):
    rows = [("i1", at(0), 1, 10), ("i1", at(100), 2, 10), ("i1", at(200), 3, 20), ("i1", at(300), 4, 30), ("i2", at(0), 5, 7), ("i2", at(50), 6, 7)]
    df = spark.createDataFrame(rows, "imsi string, ts timestamp, id bigint, teid bigint")
    moved = H.key_changes(df, ["imsi"], ["ts", "id"], "teid", slab="1s")
    found = H.interruptions(moved, df, ["imsi"], "teid", "ts", "id").orderBy("ts").collect()
    assert [(r.old_teid, r.teid, r.interruption_ms, r.quality) for r in found] == [(10, 20, 100, "ACCEPTABLE"), (20, 30, 100, "ACCEPTABLE")]


def test_quality_bands(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 49, 50, 100, 300, 1000)], "ms int")
    got = [r.q for r in df.orderBy("ms").select(codes.interruption_quality("ms").alias("q")).collect()]
    assert got == ["INVALID", "SEAMLESS", "EXCELLENT", "GOOD", "ACCEPTABLE", "POOR", "FAILED"]


def test_master_session(spark):
    """Create-session claims the address; a call with only that address and a Diameter row join the same subscriber."""
    schema = "id bigint, ts timestamp, protocol string, message_type string, imsi string, msisdn string, ue_ipv4 string, ue_ipv6 string, src_ip string, dst_ip string, session bigint"
    rows = [
        (1, at(0), "GTP_C", "GTP_CREATE_SESSION_REQ", "310", None, "10.0.0.1", None, "m", "s", 100),
        (2, at(10), "SIP", "SIP_INVITE", None, None, None, None, "10.0.0.1", "p", 200),
        (3, at(20), "DIAMETER", "DIAMETER_CCR", "310", "555", None, None, "a", "b", 300),
        (4, at(5), "SIP", "SIP_INVITE", None, None, None, None, "10.0.0.9", "p", 400),
    ]
    found = S.master_sessions(spark.createDataFrame(rows, schema), "session", "id", ["ts", "id"]).collect()
    assert [(r.imsi, r.gtp_session, r.sip_sessions, r.diameter_sessions, r.events, r.msisdn) for r in found] == [("310", 100, 1, 1, 3, "555")]


def test_charging(spark):
    """Two services in one message; the last known final unit stays, other groups have none."""
    names = "rating_group service_identifier reporting_reason result_code final_unit_action".split()
    names += [f"{way}_{unit}" for way in T.WAYS for unit in T.UNITS]
    control = lambda **known: tuple(known.get(n) for n in names)
    rows = [
        ("u", at(0), 1, [control(rating_group=1, granted_time=60, requested_time=90, final_unit_action=2, result_code=2001),
                         control(rating_group=2, used_total_octets=7, reporting_reason=3)]),
        ("u", at(9), 2, [control(rating_group=1, granted_time=5, granted_input_octets=11, result_code=4012)]),
        ("u", at(9), 3, None),
    ]
    schema = f"user string, ts timestamp, id bigint, mscc array<struct<{','.join(n + ':bigint' for n in names)}>>"
    found = {r.rating_group: r for r in T.charging_usage(spark.createDataFrame(rows, schema), ["user"], ["ts", "id"]).collect()}
    one, two = found[1], found[2]
    assert (one.reports, one.granted_time, one.requested_time, one.granted_input_octets, one.used_time) == (2, 65, 90, 11, None)
    assert (one.final_unit, one.final_unit_action, one.last_result_code, one.quota_exhausted) == (True, 2, 4012, False)
    assert (two.final_unit, two.final_unit_action, two.used_total_octets, two.quota_exhausted) == (False, None, 7, True)


def test_session_names(spark):
    keys = spark.createDataFrame([("PFCP", 5, 6), ("PFCP", None, 6), ("PFCP", None, None), ("X", 1, 2)], "kind string, f bigint, s bigint")
    blank = keys.selectExpr("*", "cast(null as string) as c", "cast(null as bigint) as n")
    key = S.protocol_session_key("kind", "c", "c", "n", "s", "n", F.lit("a-b"), "f")
    assert [r[0] for r in blank.select(key).collect()] == ["PFCP-5", "PFCP-6", "PFCP-a-b", "FLOW-a-b"]
    known = spark.createDataFrame([(None, "2"), ("1", "2"), (None, None)], "imsi string, msisdn string")
    assert [r[0] for r in known.select(S.primary_identifier(["imsi", "msisdn"])).collect()] == ["2", "1", "unknown"]
    rules = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["a"]), ("", 3, ["a"]), ("t", 4, None)], "session_id string, hop_by_hop_id int, r array<string>")
    assert sorted(map(tuple, S.charging_rules(rules, "r").collect())) == [("hop-3", "a"), ("s", "a"), ("s", "b")]


SIP = (
    "call_id string, ts timestamp, id bigint, is_request boolean, method string, status_code int, cseq_method string, from_uri string, to_uri string, "
    "request_uri string, via_count int, contact_ip string, expires int, has_audio boolean, has_video boolean, protocol string"
)


def sip(call, ms, i, method=None, status=None, cseq="INVITE", protocol="SIP", video=False, to="sip:2@x"):
    return (call, at(ms), i, method is not None, method, status, cseq, "sip:+1@x", to, to, 1, "10.0.0.1", None, True, video, protocol)


def test_full_call(spark):
    rows = [
        sip("c", 0, 1, "INVITE"), sip("c", 10, 2, status=100), sip("c", 120, 3, status=180), sip("c", 200, 4, status=200),
        sip("c", 210, 5, "ACK"), sip("c", 220, 6, protocol="RTP"), sip("c", 900, 7, "BYE"), sip("lost", 0, 8, status=180),
        sip("f", 0, 9, "INVITE"), sip("f", 50, 10, status=486), sip("m", 0, 11, "INVITE", video=True), sip("m", 5, 12, "ACK"), sip("m", 6, 13, protocol="RTP"),
        sip("e", 0, 14, "INVITE", to="urn:service:sos"),
    ]
    df = spark.createDataFrame(rows, SIP)
    kpis = {r.call_id: r for r in C.call_kpis(df, "call_id", "ts").collect()}
    assert (kpis["c"].setup_time_ms, kpis["c"].ring_time_ms, kpis["c"].call_duration_ms) == (200, 120, 700)
    states = {r.call_id: r.state for r in C.call_states(df.withColumn("ev", C.call_event()), "call_id", ["ts", "id"], F.col("ev")).collect()}
    assert states == {"c": "COMPLETED", "f": "FAILED", "m": "MEDIA_ACTIVE", "e": "INITIATING"}
    kinds = {r.call_id: r.session_type for r in C.sip_sessions(df, "call_id", ["ts", "id"]).collect()}
    assert kinds == {"c": "VOICE_CALL", "f": "VOICE_CALL", "m": "VIDEO_CALL", "e": "EMERGENCY_CALL", "lost": "UNKNOWN"}


def test_participants_with_explicit_mapping(spark):
    schema = "s int, ts timestamp, id bigint, protocol string, message_type string, application_id bigint, src_ip string, src_port int, dst_ip string, dst_port int"
    rows = [
        (1, at(0), 1, "S1AP", "S1AP_INITIAL_UE_MESSAGE", None, "e1", 36412, "m1", 36412),
        (1, at(1), 2, "S1AP", "S1AP_INITIAL_UE_MESSAGE", None, "e2", 36412, "m1", 36412),
        (1, at(2), 3, "SIP", "SIP_REGISTER", None, "u1", 5060, "p1", 5060),
        (1, at(3), 4, "HTTP2", "X", None, "h1", 0, "h2", 443),
    ]
    df = spark.createDataFrame(rows, schema)
    mapping = spark.createDataFrame([("h2", "SMF")], "ip string, role string")
    people = D.participants(df, ["s"], ["ts", "id"], mapping)
    assert {r.ip: r.participant for r in people.collect()} == {
        "e1": "ENODEB", "m1": "MME", "e2": "ENODEB-02", "u1": "UE", "p1": "P-CSCF", "h1": "UNKNOWN-h1", "h2": "SMF",
    }
    assert D.diagram_rows(df.filter("id < 0"), people, ["s"], ["ts", "id"]).count() == 0
    with_ports = spark.createDataFrame(
        [("h2", "SMF", 443), ("h2", "NRF", 80), ("p1", "SBC", 9999), ("u1", "PHONE", 7), ("u1", "TABLET", None)], "ip string, role string, port int"
    )
    people = {r.ip: r.role for r in D.participants(df, ["s"], ["ts", "id"], with_ports).collect()}
    assert (people["h2"], people["p1"], people["u1"], people["e1"]) == ("SMF", "SBC", "TABLET", "ENODEB")


def test_rules(spark):
    df = spark.createDataFrame([(1, "SIP", 1.5, True), (2, "RTP", None, False)], "n int, protocol string, x double, ok boolean")
    pick = lambda *rules: [r.n for r in FI.rule_filter(df, list(rules)).orderBy("n").collect()]
    assert pick('protocol == "SIP"') == [1] and pick("protocol != SIP") == [2]
    assert pick("x > 1.0") == [1] and pick("x > 1") == [] and pick("n >= 2", "ok == true") == [1, 2]
    assert pick("missing == 1") == [] and pick() == []
    assert pick("x < 12345678901234567890") == [1] and pick("n < 12345678901234567890") == [] and pick("n < 1_0") == []
    with pytest.raises(ValueError):
        pick("what is this")


def test_interval_texts():
    assert [core.interval_seconds(t) for t in ("30s", "5m", "1h", "1d", "1w", "90", "", "2x")] == [30, 300, 3600, 86400, 604800, 90, 3600, 3600]
