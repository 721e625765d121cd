"""Call flows on hand-made sessions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signaloom.operators import flows as FL

BASE = datetime(2024, 1, 1)
SESSION = (
    "call_id string, session_type string, caller string, callee string, caller_ip string, callee_ip string, start_ts timestamp, end_ts timestamp, "
    "messages long, forward_target string, icid string"
)
LEG = (
    "leg_id string, kind string, start_ts timestamp, end_ts timestamp, address string, imsi string, number string, messages long, "
    "loss_rate double, jitter_ms double, mos double"
)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


SESSIONS = [
    ("a", "VOICE_CALL", "+14155551234", "+14155559876", "10.0.0.1", "10.0.0.2", at(0), at(60), 7, None, None),
    ("b", "VIDEO_CALL", "tel:+14155551234", "+12125550000", "10.0.0.1", None, at(30), at(90), 5, None, None),
    ("c", "VOICE_CALL", "04155550001", "+14155550002", None, "2001:db8:1:2:3::9", at(200), at(260), 9, "+16465550003", "ic-1"),
    ("r", "REGISTRATION", "+14155551234", None, "10.0.0.1", None, at(0), at(1), 2, None, None),
    ("s", "SMS_MESSAGE", "+14155551234", "+14155559876", None, None, at(5), at(6), 2, None, None),
    ("o", "OPTIONS", None, None, None, None, at(5), at(6), 1, None, None),
]


def leg(i, kind, start, end, address=None, imsi=None, number=None, messages=1, loss=None, jitter=None, mos=None):
    return (i, kind, at(start), at(end), address, imsi, number, messages, loss, jitter, mos)


LEGS = [
    leg("gx in time", "Gx", -5, -4, "10.0.0.1", messages=3),
    leg("gx early", "Gx", -5.001, 3, "10.0.0.2"),
    leg("rx after", "Rx", 92, 93, "10.0.0.1", messages=2),
    leg("rx too late", "Rx", 92.001, 93, "10.0.0.1"),
    leg("cx", "Cx", -30, -29, number="14155551234"),
    leg("sh by ending", "Sh", 40, 41, number="00499155559876"[2:].replace("49915", "1415")),
    leg("gtp", "GTP", 63, 64, imsi="001010000000007", number="4155551234", messages=4),
    leg("gtp of nobody", "GTP", 10, 11, imsi="001010000000009", number="99"),
    leg("nas", "NAS", 10, 11, imsi="001010000000007", messages=6),
    leg("nas of callee", "NAS", 210, 211, imsi="001010000000002"),
    leg("nas of nobody", "NAS", 10, 11, imsi="001010000000008"),
    leg("media", "RTP", 20, 300, "10.0.0.2", messages=100, loss=0.02, jitter=4.0, mos=4.0),
    leg("poor media", "RTP", -50, 1, "10.0.0.1", messages=50, loss=0.0, jitter=8.0, mos=2.5),
    leg("media before", "RTP", -50, -1, "10.0.0.1"),
    leg("v6 media", "RTP", 250, 400, "2001:db8:1:2:4::1", messages=10, mos=3.0),
    leg("charged", "Rx", 255, 256, "10.0.0.1"),
]


@pytest.fixture(scope="module")
def built(spark):
    sessions = spark.createDataFrame(SESSIONS, SESSION)
    rows = spark.createDataFrame(LEGS, LEG)
    keys = FL.key_list(
        F.when(F.col("leg_id") == "charged", FL.icid_key(F.lit("ic-1"))), FL.imsi_key(F.when(F.col("kind") == "NAS", F.col("imsi"))),
        *FL.number_keys(F.col("number")), FL.address_key(F.col("address")),
    )
    legs = rows.select("leg_id", "kind", "start_ts", "end_ts", keys.alias("keys"), "imsi", "number", "messages", "loss_rate", "jitter_ms", "mos")
    registry = spark.createDataFrame([("+1 415 555 0002", "001010000000002"), ("+14155550002", "001010000000003")], "number string, imsi string")
    return FL.assemble(sessions, legs, registry)


def test_each_leg_goes_to_one_call(built):
    owners = {r["leg_id"]: r["call_id"] for r in built[1].collect()}
    assert owners == {
        "gx in time": "a", "rx after": "b", "cx": "a", "sh by ending": "a", "gtp": "a", "nas": "a", "nas of callee": "c", "media": "a",
        "poor media": "a", "v6 media": "c", "charged": "c",
    }


def test_flow_totals(built):
    flows = {r["call_id"]: r for r in built[0].collect()}
    a = flows["a"]
    assert (a["sip_messages"], a["diameter_messages"], a["gtp_messages"], a["nas_messages"], a["rtp_packets"]) == (7, 5, 4, 6, 150)
    assert (a["gx_legs"], a["rx_legs"], a["cx_legs"], a["sh_legs"], a["rtp_legs"]) == (1, 0, 1, 1, 2)
    assert a["max_loss_percent"] == pytest.approx(2.0) and a["jitter_ms"] == pytest.approx(6.0) and a["mos"] == 2.5
    assert a["caller_imsi"] == "001010000000007"  # told by the GTP leg
    assert flows["c"]["callee_imsi"] == "001010000000002"  # the smallest the registry has
    assert flows["b"]["rtp_packets"] == 0 and flows["b"]["mos"] is None


def test_flow_types_and_ids(built):
    flows = {r["call_id"]: r for r in built[0].collect()}
    assert {c: r["flow_type"] for c, r in flows.items()} == {
        "a": "MO_VOICE_CALL", "b": "MO_VIDEO_CALL", "c": "VOICE_CALL_FORWARDING", "r": "IMS_REGISTRATION", "s": "MO_SMS", "o": "UNKNOWN",
    }
    assert flows["a"]["flow_id"] == "1704067200.000000_V_a" and flows["s"]["flow_id"] == "1704067205.000000_V_SIP_s"
    assert flows["r"]["caller"] is None and flows["r"]["caller_ip"] is None


def test_lookups(spark, built):
    flows, claimed, legs = built

    def of(found):
        return sorted(r["call_id"] for r in found.collect())

    number = lambda *n: spark.createDataFrame([(x,) for x in n], "number string")
    assert of(FL.flows_by_number(flows, number("sip:+14155551234@ims.example.com;user=phone"))) == ["a", "b"]
    assert of(FL.flows_by_number(flows, number("16465550003", "nothing"))) == ["c"]
    assert of(FL.flows_by_subscriber(flows, spark.createDataFrame([("001010000000007",)], "imsi string"))) == ["a"]
    assert of(FL.flows_by_id(flows, spark.createDataFrame([("1704067205.000000_V_SIP_s",), ("x",)], "flow_id string"))) == ["s"]
    assert of(FL.voice_flows(flows)) == ["a", "c"] and of(FL.video_flows(flows)) == ["b"]
    sip = spark.createDataFrame([("a", 1), ("a", 2), ("r", 3)], "call_id string, frame_number long")
    of_legs = spark.createDataFrame([("gtp", "GTP", 2), ("gtp", "GTP", 4), ("gx early", "DIAMETER", 5)], "leg_id string, protocol string, frame_number long")
    frames = FL.flow_frames(flows, sip, claimed, of_legs)
    assert sorted((r["protocol"], r["frame_number"]) for r in frames.collect()) == [("GTP", 2), ("GTP", 4), ("SIP", 1), ("SIP", 2), ("SIP", 3)]
    assert of(FL.flows_by_frame(flows, frames, spark.createDataFrame([(2,), (3,), (5,)], "frame_number long"))) == ["a", "a", "r"]
    counts = {r["what"]: r["n"] for r in FL.flow_counts(flows, legs, claimed).collect()}
    assert counts["flows"] == 6 and counts["unclaimed GTP"] == 1 and counts["unclaimed RTP"] == 1 and "unclaimed Cx" not in counts


def test_documents_hold_every_leg(built):
    flows, claimed, legs = built
    parts = FL.flow_documents(flows, legs, claimed, part_legs=2).collect()
    assert sorted(r["part"] for r in parts if r["flow_id"].endswith("_V_a")) == [0, 1, 2, 3]
    assert sum(r["document"].count('"leg_id"') for r in parts) == claimed.count()
    assert all(('"flow_type"' in r["document"]) == (r["part"] == 0) for r in parts)


def test_no_sessions_and_no_legs(spark, built):
    flows, claimed, legs = built
    sessions = spark.createDataFrame(SESSIONS, SESSION)
    registry = spark.createDataFrame([], "number string, imsi string")
    alone, none, _ = FL.assemble(sessions, legs.limit(0), registry)
    assert alone.count() == 6 and none.count() == 0
    nothing, none, left = FL.assemble(sessions.limit(0), legs, registry)
    assert nothing.count() == 0 and none.count() == 0 and left.count() == len(LEGS)


def test_numbers_are_read_in_few_steps(spark):
    """Each expression that reads a number is in the plan once, not once for every place that uses its result."""
    frame = spark.createDataFrame([("tel:+1-415-555-1234",), ("04155551234",), ("none",), ("",), (None,)], "t string")
    plan = frame.select(FL.number_key_list(F.col("t")).alias("k"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 8
    assert [r["k"] for r in plan.collect()] == [
        ["number:4155551234", "ending:155551234"], ["number:4155551234", "ending:155551234"], [], [], [],
    ]
    listed = frame.select(FL.key_list(*FL.number_keys(F.col("t"))).alias("k"))
    assert listed.collect() == plan.collect()


def test_ratings_are_those_of_whole_flows(spark, built):
    flows, _claimed, legs = built
    rated = FL.ratings(spark.createDataFrame(SESSIONS, SESSION), legs)
    assert {r["call_id"]: r["mos"] for r in rated.collect()} == {r["call_id"]: r["mos"] for r in flows.collect()}
