"""Streams with stored state: restarts, hot keys, compaction, what a batch writes."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from signaloom.session import fresh_path
from signaloom.streaming import ordered as O
from signaloom.streaming.merging import OnlineMerge
from signaloom.streaming.store import DeltaTable, EpochLog

BASE = datetime(2024, 1, 1)
ROW = "user string, ts timestamp, id bigint, kind string, value string"


def feed(spark, batches, run, schema=ROW):
    """Each batch is a run of its own that goes on where the one before stopped."""
    path, found = fresh_path(spark, "input"), None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        found = run(spark.readStream.schema(schema).parquet(path))
    return found


def keyed(stream):
    return O.keyed_rows(stream, "user", "ts", "id", F.col("kind"), F.col("value"))


def dealt(rows, parts, end):
    """Rows in parts by time, then one from long after."""
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)] + [[("end", BASE + timedelta(days=end), 10**9, "ROW", None)]]


def test_claims_of_one_hot_key(spark):
    """Every probe gets the latest claim, over four runs with a copy of the state in between."""
    rnd = random.Random(2)
    rows = [("hot" if k % 3 else f"u{k % 7}", BASE + timedelta(seconds=rnd.randrange(90_000)), k, rnd.choice(["CLAIM", "PROBE"]), f"v{k}") for k in range(600)]
    claims = O.LastClaim(spark, 3_600_000_000, compact_every=2)
    found = {r.probe_id: r.value for r in feed(spark, dealt(rows, 4, 9), lambda s: claims.run(keyed(s))).collect()}
    want = {}
    for user, ts, i, kind, _ in rows:
        if kind == "PROBE":
            before = [(t, j, v) for u, t, j, k, v in rows if k == "CLAIM" and u == user and t <= ts]
            last = max(before, default=None)
            want[i] = last[2] if last and ts - last[0] <= timedelta(hours=1) else None
    assert found == want


def plain_lives(rows, idle, longest):
    out = []
    for user in {r[0] for r in rows}:
        life = None
        for _, ts, _, kind, _ in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            at = int((ts - BASE).total_seconds())
            if life and at > min(life[1] + idle, life[0] + longest):
                out.append((user, *life, "IDLE" if life[1] + idle <= life[0] + longest else "LIMIT"))
                life = None
            life = [life[0], at, life[2] + 1] if life else [at, at, 1]
            if kind == "END":
                out.append((user, *life, "END"))
                life = None
        if life:
            out.append((user, *life, "IDLE" if life[1] + idle <= life[0] + longest else "LIMIT"))
    return sorted(out)


@pytest.mark.parametrize("longest", [86_400, 5_000])
def test_lives_over_runs(spark, longest):
    rnd = random.Random(longest)
    rows = [("hot" if k % 3 else f"u{k % 5}", BASE + timedelta(seconds=k * 60 + rnd.randrange(50) + 9000 * (k // 90)), k, "END" if rnd.random() < 0.03 else "ROW", None) for k in range(500)]
    lives = O.Lifecycle(spark, 7_200_000_000, longest * 1_000_000, compact_every=2)
    start = int(BASE.timestamp() * 0) + 1_704_067_200
    found = feed(spark, dealt(rows, 3, 30), lambda s: lives.run(keyed(s))).filter("key <> 'end'").collect()
    assert sorted((r.key, r.opened_at // 1_000_000 - start, r.last_at // 1_000_000 - start, r.rows, r.ended_by) for r in found) == plain_lives(rows, 7200, longest)


def test_repeats_over_runs(spark):
    rnd = random.Random(4)
    rows = [(f"s{k % 3}", BASE + timedelta(seconds=rnd.randrange(40_000)), k, "ROW", None) for k in range(300)]
    repeats = O.NearRepeat(spark, 60_000_000)
    found = feed(spark, dealt(rows, 3, 9), lambda s: repeats.run(keyed(s)))
    want, last = set(), {}
    for user, ts, i, _, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if user not in last or ts - last[user] > timedelta(seconds=60):
            want.add(i)
        last[user] = ts
    assert {r.row_id for r in found.collect()} == want


def test_late_rows_are_dropped_and_a_batch_may_run_again(spark):
    claims = O.LastClaim(spark, 10**12, delay_ms=1000)
    at = lambda s: BASE + timedelta(seconds=s)
    one = keyed(spark.createDataFrame([("u", at(0), 1, "CLAIM", "a"), ("u", at(100), 2, "PROBE", None)], ROW))
    two = keyed(spark.createDataFrame([("u", at(5), 3, "CLAIM", "late"), ("u", at(200), 4, "PROBE", None)], ROW))
    claims.handle(one, 0)
    for _ in range(2):  # the second micro-batch was not noted and is run again
        claims.handle(two, 1)
    assert {r.probe_id: r.value for r in claims.results().collect()} == {2: "a"}
    with pytest.raises(ValueError, match="follows no finished one"):
        O.LastClaim(spark, 1).handle(one, 3)


def test_merge_writes_what_a_batch_touches(spark):
    """What a micro-batch writes follows the batch, not what was merged before; a copy now and then; ids merged in a chain."""
    merge = OnlineMerge(spark, "id", {"imsi": F.col("imsi"), "msisdn": F.col("msisdn")}, compact_every=3)
    schema = "id bigint, imsi string, msisdn string"
    batches = [
        [(k, f"i{k}", f"m{k}") for k in range(100, 1100)], [(2000, "i100", "m101")], [(2001, "i101", "m102")], [(50, "i102", None)], [(2003, "new", "m5000")],
    ]
    found = {r.node: r.session_id for r in feed(spark, batches, merge.run, schema).collect()}
    assert {found[n] for n in ("imsi:i100", "msisdn:m101", "imsi:i101", "msisdn:m102", "imsi:i102")} == {50}
    assert found["imsi:i500"] == 500 and found["imsi:new"] == 2003 and len(found) == 2002
    state = merge.log.read()
    assert state.latest == 4 and state.base == 2 and state.since == (3, 4)
    rows = {e: spark.read.parquet(f"{merge.root}/nodes/delta/epoch={e}").count() for e in range(5)}
    assert rows == {0: 2000, 1: 2, 2: 2, 3: 1, 4: 2}
    assert Path(f"{merge.root}/nodes/copy-2").exists()


def test_gone_keys_and_lost_state(spark):
    root = fresh_path(spark, "store")
    table, log = DeltaTable(spark, f"{root}/t", "k", "k string, v bigint", buckets=2, compact_every=2), EpochLog(spark, root)
    rows = lambda *r: spark.createDataFrame(r, "k string, v bigint, gone boolean")
    assert log.read() is None and table.read(None).count() == 0
    for epoch, batch in enumerate((rows(("a", 1, False), ("b", 2, False)), rows(("a", 3, False), ("b", None, True)), rows(("c", 4, False)))):
        table.put(batch, epoch)
        log.note(epoch, table.finish(log.read(before=epoch), epoch))
    assert {r.k: r.v for r in table.read(log.read()).collect()} == {"a": 3, "c": 4}
    assert {r.k: r.v for r in table.read(log.read(before=1)).collect()} == {"a": 1, "b": 2}
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    assert {r.k: r.v for r in table.read(log.read(), asked).collect()} == {"a": 3}
    log.note(3, 1)  # noted, but its rows are not there
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.read(log.read()).count()
