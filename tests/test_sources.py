"""Key extraction, capture typing, sinks and streams over several micro-batches."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from signaloom.session import fresh_path, work_dir
from signaloom.sources import captures, messages, sinks
from signaloom.streaming import ordered as O
from signaloom.streaming import windows as W
from signaloom.streaming.merging import OnlineMerge
from signaloom.streaming.running import run_batches, run_counting_late, run_to_table

BASE = datetime(2024, 1, 1)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


BODIES = [
    ("GTP_C", {"header": {"teid": 77}, "imsi": "310260000000001", "msisdn": "1415", "ue_ipv4": "10.0.0.1"},
     dict(teid_s1u=77, imsi="310260000000001", msisdn="1415", ue_ipv4="10.0.0.1")),
    ("SIP", {"call_id": "c1", "p_charging_vector": {"icid_value": "x"}, "p_asserted_identity": [{"username": "+14155551234"}, {"username": "31026000000001"}],
             "sdp": {"connection_address": "2001:db8::1"}},
     dict(sip_call_id="c1", icid="x", imsi="31026000000001", msisdn="14155551234", ue_ipv6="2001:db8::1")),
    ("SIP", {"authorization_username": "310260000000009", "p_asserted_identity": [{"username": "4155551234"}], "sdp": {"connection_address": "10.0.0.7"}},
     dict(imsi="310260000000009", msisdn="4155551234", ue_ipv4="10.0.0.7")),
    ("SIP", {"p_associated_uri": ["sip:310260000000005@ims"], "call_id": "c2"}, dict(imsi="310260000000005", sip_call_id="c2")),
    ("DIAMETER", {"subscription_ids": [{"type": 0, "data": "999"}, {"type": 1, "data": "310260000000002"}]}, dict(msisdn="999", imsi="310260000000002")),
    ("DIAMETER", {"imsi": "310260000000003", "user_name": "bob"}, dict(imsi="310260000000003")),
    ("PFCP", {"header": {"seid": 5}, "ue_ip_address": "10.0.0.2"}, dict(seid_n4=5, ue_ipv4="10.0.0.2")),
    ("SCTP", {"ran_ue_ngap_id": 3, "amf_ue_ngap_id": 4}, dict(ran_ue_ngap_id=3, amf_ue_ngap_id=4)),
    ("RTP", {}, {}),
]


def test_extracted_keys(spark):
    df = spark.createDataFrame([(i, p, json.dumps(b)) for i, (p, b, _) in enumerate(BODIES)], "i int, protocol string, parsed_data string")
    got = {r.i: r.asDict() for r in messages.with_correlation_keys(df).collect()}
    names = messages.correlation_keys()
    for i, (_, _, expected) in enumerate(BODIES):
        assert {n: got[i][n] for n in names if got[i][n] is not None} == expected


def test_capture_types(spark):
    names = [("eth0", "S1-MME link", "S1_MME"), ("s1u0", "S1U user", "S1_U"), ("if", "X2AP", "X2_C"), ("n", "PFCP", "N4"), ("v", "voice", "RTP_MEDIA"), ("z", "", "UNKNOWN")]
    df = spark.createDataFrame(names, "name string, description string, expected string")
    rows = df.select("expected", captures.type_of_name(F.concat_ws(" ", "name", "description")).alias("got")).collect()
    assert [(r.expected, r.got) for r in rows if r.expected != r.got] == []
    traffic = spark.createDataFrame([("a", 443, 5000, "NGAP"), ("b", 443, 5000, "TCP"), ("c", 3868, 1, "DIAMETER"), ("d", 3868, 1, "TCP"), ("e", 12000, 1, "UDP")], "i string, s int, d int, p string")
    assert {r.i: r.interface_type for r in captures.type_of_traffic(traffic, "i", ("s", "d"), "p").collect()} == {"a": "N6", "b": "SG_I", "c": "S6A", "d": "UNKNOWN", "e": "RTP_MEDIA"}


def test_long_session_is_written_whole(spark):
    events = spark.createDataFrame([(1, at(i), i, i * 10) for i in range(25)] + [(2, at(0), 99, 1)], "s int, ts timestamp, id bigint, size int")
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "s int, kind string")
    got = sinks.session_documents(heads, events, "s", ["ts", "id"], ["id", "size"], events_per_document=10, slab="7s")
    parts = [json.loads(r.document) for r in got.orderBy("s", "part").collect()]
    assert [(p["s"], p["part"], p["kind"], len(p["events"])) for p in parts] == [(1, 0, "a", 10), (1, 1, "a", 10), (1, 2, "a", 5), (2, 0, "b", 1)]
    assert [e["id"] for p in parts[:3] for e in p["events"]] == list(range(25))


def test_work_dir_is_the_configured_one(spark):
    assert fresh_path(spark, "x").startswith(work_dir(spark)) and work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def written_in_batches(spark, rows, schema):
    """A folder with one file per batch, to be read one file at a time in time order."""
    path = fresh_path(spark, "input")
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


ROW = "user string, ts timestamp, id bigint, kind string, value string"


def test_state_is_carried_over_batches(spark):
    batches = [
        [("u", at(0), 1, "CLAIM", "a"), ("u", at(400), 2, "PROBE", None)],
        # Out of order within the delay: the claim at 300 belongs before the probe at 400.
        [("u", at(300), 3, "CLAIM", "b"), ("v", at(1500), 4, "PROBE", None)],
        [("u", at(5000), 5, "PROBE", None), ("z", at(9000), 6, "PROBE", None)],
    ]
    stream = written_in_batches(spark, batches, ROW)
    found = O.LastClaim(spark, 1_000_000_000).run(O.keyed_rows(stream, "user", "ts", "id", F.col("kind"), F.col("value")))
    assert {r.probe_id: r.value for r in found.collect()} == {2: "b", 4: None, 5: None}


def test_pairing_times_out(spark):
    batches = [
        [("k", at(0), 1, "REQ", None), ("k", at(1), 2, "RESP", None), ("k", at(10), 3, "REQ", None)],
        [("k", at(200), 4, "REQ", None), ("k", at(260), 5, "RESP", None)],
        [("end", at(9000), 6, "REQ", None), ("end", at(9000), 7, "RESP", None)],
    ]
    stream = written_in_batches(spark, batches, ROW)
    requests = stream.filter("kind = 'REQ'").select("user", F.col("id").alias("request_id"), F.col("ts").alias("requested_at"))
    answers = stream.filter("kind = 'RESP'").select("user", F.col("ts").alias("answered_at"))
    pairs = W.request_pairs(requests, answers, ["user"], "request_id", "requested_at", "answered_at", "30 seconds")
    found, _ = run_to_table(pairs, "pairs")
    assert {r.request_id: r.answered_at is not None for r in found.collect()} == {1: True, 3: False, 4: False}


def test_late_rows_are_counted(spark):
    batches = [[("a", at(0), 1, "x", None)], [("a", at(90_000), 2, "x", None)], [("a", at(95_000), 3, "x", None)], [("a", at(5), 4, "x", None)]]
    counts = W.tumbling_counts(written_in_batches(spark, batches, ROW), "ts", "1 hour", delay="1 minute")
    closed, late = run_counting_late(counts, "late")
    assert late == 1
    assert [(r.n) for r in closed.orderBy("bucket").collect()][0] == 1


def test_online_merge_over_batches(spark):
    schema = "id bigint, imsi string, msisdn string"
    batches = [[(1, "i1", None), (2, None, "m1")], [(3, "i2", "m2")], [(4, "i1", "m1")], [(5, "i2", "m1")]]
    merge = OnlineMerge(spark, "id", {"imsi": F.col("imsi"), "msisdn": F.col("msisdn")})
    known = merge.run(written_in_batches(spark, batches, schema))
    assert {r.node: r.session_id for r in known.collect()} == {"imsi:i1": 1, "msisdn:m1": 1, "imsi:i2": 1, "msisdn:m2": 1}


def test_online_merge_goes_on_after_a_restart(spark):
    schema, path, root = "id bigint, imsi string, msisdn string", fresh_path(spark, "input"), fresh_path(spark, "merge")
    keys = {"imsi": F.col("imsi"), "msisdn": F.col("msisdn")}
    for rows in ([(1, "i1", None), (2, None, "m1")], [(3, "i1", "m1"), (4, "i9", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        known = OnlineMerge(spark, "id", keys, root).run(spark.readStream.schema(schema).parquet(path))
    assert {r.node: r.session_id for r in known.collect()} == {"imsi:i1": 1, "msisdn:m1": 1, "imsi:i9": 4}
    # Started once more without new data.
    again = OnlineMerge(spark, "id", keys, root).run(spark.readStream.schema(schema).parquet(path))
    assert {r.node: r.session_id for r in again.collect()} == {"imsi:i1": 1, "msisdn:m1": 1, "imsi:i9": 4}


def test_lifecycle_ends(spark):
    batches = [
        [("a", at(0), 1, "ROW", None), ("a", at(50), 2, "ROW", None), ("a", at(90), 3, "ROW", None), ("a", at(130), 4, "ROW", None)],
        [("b", at(0), 5, "ROW", None), ("b", at(30), 6, "END", None), ("c", at(10), 7, "ROW", None), ("z", at(9000), 8, "ROW", None)],
    ]
    keyed = O.keyed_rows(written_in_batches(spark, batches, ROW), "user", "ts", "id", F.col("kind"))
    found = O.Lifecycle(spark, 60_000_000, 100_000_000).run(keyed)
    assert sorted((r.key, r.rows, r.ended_by) for r in found.collect()) == [("a", 1, "IDLE"), ("a", 3, "LIMIT"), ("b", 2, "END"), ("c", 1, "IDLE")]


def test_handover_callback_per_batch(spark):
    """What a callback would be told of is one frame per micro-batch."""
    seen = []
    stream = written_in_batches(spark, [[("u", at(0), 1, "a", None)], [("u", at(1), 2, "b", None)]], ROW)
    run_batches(stream, "callback", lambda batch, epoch: seen.extend((epoch, r.id) for r in batch.select("id").collect()))
    assert sorted(i for _, i in seen) == [1, 2] and len({e for e, _ in seen}) == 2


def test_table_sink_keeps_what_is_there(spark):
    path = fresh_path(spark, "sink")
    write = lambda rows: sinks.write_table(spark.createDataFrame(rows, "id int, job string, v int"), path, "id", "job")
    write([(1, "a", 1), (1, "a", 1), (2, "b", 2)])
    write([(3, "b", 3), (1, "c", 9)])
    assert sorted((r.id, r.job) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_stream_without_closed_time(spark):
    rows = [[("a", at(0), 1, "ROW", None)]]
    keyed = O.keyed_rows(written_in_batches(spark, rows, ROW), "user", "ts", "id", F.col("kind"))
    found = O.NearRepeat(spark, 1000).run(keyed)
    assert found.count() == 0
