"""Timelines and pairing against plain loops, with a key that holds most rows and slabs of any width."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signaloom.operators import pairing as P
from signaloom.operators.asof import asof_join, earliest_claim
from signaloom.operators.timeline import carry_along, fit_slab, following, last_known, previous, row_number, rows_after, running

BASE = datetime(2024, 1, 1)


def rows(seed, n=300):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(400), i, rng.choice([None, rng.randrange(50)]))
        for i in range(n)
    ]


@pytest.mark.parametrize("slab", [1, 7, 90, 10_000])
@pytest.mark.parametrize("reverse", [False, True])
def test_carried_values_do_not_depend_on_slabs(spark, slab, reverse):
    data = rows(slab)
    df = spark.createDataFrame(data, "key string, t bigint, id bigint, v int")
    got = carry_along(
        df, ["key"], ["t", "id"], slab, reverse,
        before=previous(F.col("v")), known=last_known(F.col("v")), known_now=last_known(F.col("v"), inclusive=True),
        total=running("sum", F.coalesce("v", F.lit(0))), top=running("max", F.col("v"), inclusive=False), nth=row_number(),
        after=following(F.col("v")), left=rows_after(),
    )
    expected = {}
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]), reverse=reverse)
        for i, r in enumerate(mine):
            seen = [x[3] for x in mine[:i]]
            known = [x for x in seen if x is not None]
            expected[r[2]] = (
                seen[-1] if seen else None,
                known[-1] if known else None,
                r[3] if r[3] is not None else (known[-1] if known else None),
                sum(x or 0 for x in seen) + (r[3] or 0),
                max(known) if known else None,
                i + 1,
                mine[i + 1][3] if i + 1 < len(mine) else None,
                len(mine) - i - 1,
            )
    found = {r.id: (r.before, r.known, r.known_now, r.total, r.top, r.nth, r.after, r.left) for r in got.collect()}
    assert found == expected


def test_fitted_width_bounds_the_heaviest_key(spark):
    # One key holds most rows, most of them within a thousandth of the time range.
    data = [("hot", i % 1000 if i % 3 else i * 1000, i) for i in range(3000)] + [("cold", 5, 9000)]
    df = spark.createDataFrame(data, "key string, t bigint, id bigint")
    assert fit_slab(df, ["key"], "t", 10_000) == max(r[1] for r in data) + 1
    width = fit_slab(df, ["key"], "t", 100)
    heaviest = df.groupBy("key", F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0]
    assert heaviest <= 100 and width >= 1
    assert fit_slab(df.filter("id < 0"), ["key"], "t") == 1


def test_rows_without_key_belong_to_no_timeline(spark):
    df = spark.createDataFrame([(None, 1, 1), ("a", 2, 2)], "key string, t bigint, id bigint")
    assert [r.id for r in carry_along(df, ["key"], ["t", "id"], 10, n=row_number()).collect()] == [2]


@pytest.mark.parametrize("seed", range(3))
def test_stack_match(spark, seed):
    rng = random.Random(seed)
    data = [("k%d" % (i % 2), i * 3, i, rng.choice(["REQ", "RESP"])) for i in range(400)]
    expected = {}
    for key in ("k0", "k1"):
        stack = []
        for _, t, i, kind in (r for r in data if r[0] == key):
            if kind == "REQ":
                stack.append(i)
                expected[i] = None
            elif stack:
                expected[stack.pop()] = t
    df = spark.createDataFrame(data, "key string, t bigint, id bigint, kind string")
    got = P.latest_unanswered(df, ["key"], ["t", "id"], F.col("kind"), slab=50)
    assert {r.id: r.response_ts for r in got.collect()} == expected


def test_latest_request_is_used_by_first_response(spark):
    at = lambda ms: BASE + timedelta(milliseconds=ms)
    data = [("c", at(0), 1, "REQ"), ("c", at(10), 2, "REQ"), ("c", at(30), 3, "RESP"), ("c", at(50), 4, "RESP")]
    df = spark.createDataFrame(data, "key string, ts timestamp, id bigint, kind string")
    found = P.request_latency(df, ["key"], ["ts", "id"], F.col("kind"), slab="1s").collect()
    assert [(r.id, r.latency_us) for r in found] == [(3, 20_000)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("slab", [3, 1000])
def test_asof_join(spark, forward, slab):
    rng = random.Random(slab)
    probes = [(i, rng.choice(["a", "b", None]), rng.randrange(60)) for i in range(80)]
    claims = [(i, rng.choice(["a", "b"]), rng.randrange(60), f"v{i}") for i in range(40)]
    left = spark.createDataFrame(probes, "pid bigint, key string, t bigint")
    right = spark.createDataFrame(claims, "cid bigint, key string, t bigint, v string")
    got = asof_join(left, right, ["key"], F.col("t"), F.col("t"), "cid", forward=forward, slab=slab)
    expected = {}
    for pid, key, t in probes:
        if forward:
            fits = [(c[2], c[0], c[3]) for c in claims if c[1] == key and c[2] >= t]
            expected[pid] = min(fits)[2] if fits else None
        else:
            fits = [(c[2], c[0], c[3]) for c in claims if c[1] == key and c[2] <= t]
            expected[pid] = max(fits)[2] if fits else None
    assert {r.pid: r.claim.v if r.claim else None for r in got.collect()} == expected


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tolerance", [0, 4])
def test_earliest_claim(spark, seed, tolerance):
    rng = random.Random(seed)
    windows = [(i, rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(40)) for i in range(60)]
    legs = [(i, k, s := rng.randrange(220), s + rng.choice([0, 0, 15])) for i in range(80) for k in rng.sample("ab", rng.choice([1, 2]))]
    got = earliest_claim(
        spark.createDataFrame(legs, "leg bigint, key string, s bigint, e bigint"),
        spark.createDataFrame(windows, "win bigint, key string, s bigint, e bigint"),
        ["key"], "leg", "s", "e", "win", "s", "e", tolerance, slab=25,
    )
    expected = {}
    for leg, key, s, e in legs:
        for win, k, ws, we in windows:
            if k == key and we >= s - tolerance and ws <= e + tolerance:
                expected[leg] = min(expected.get(leg, (ws, win)), (ws, win))
    assert {r.leg: r.win for r in got.collect()} == {leg: best[1] for leg, best in expected.items()}


def test_near_duplicates(spark):
    at = lambda us: BASE + timedelta(microseconds=us)
    df = spark.createDataFrame([("s", at(0), 1), ("s", at(900), 2), ("s", at(2500), 3), ("r", at(2600), 4)], "sig string, ts timestamp, id bigint")
    found = P.near_duplicates(df, ["sig"], ["ts", "id"], slab="1s").collect()
    assert sorted(r.id for r in found if r.is_duplicate) == [2]


def test_rows_without_key_or_time_stay(spark):
    df = spark.createDataFrame([("s", BASE, 1), (None, BASE, 2), ("s", None, 3), ("s", BASE, 4)], "sig string, ts timestamp, id bigint")
    found = {r.id: r.is_duplicate for r in P.near_duplicates(df, ["sig"], ["ts", "id"]).collect()}
    assert found == {1: False, 2: False, 3: False, 4: True}
    assert {r.id: r.sequence for r in P.sequence_in_leg(df, ["sig"], ["ts", "id"]).collect()} == {1: 0, 2: None, 3: None, 4: 1}
    assert {r.id: r.gap_us for r in P.inter_event_gaps(df, ["sig"], ["ts", "id"]).collect()} == {1: None, 2: None, 3: None, 4: 0}
    claims = spark.createDataFrame([("s", 5, 70)], "sig string, at bigint, owner bigint")
    probes = spark.createDataFrame([("s", 9, 1), ("s", None, 2), (None, 9, 3)], "sig string, at bigint, id bigint")
    found = asof_join(probes, claims, ["sig"], F.col("at"), F.col("at"), "owner").select("id", "claim.owner").collect()
    assert {r.id: r.owner for r in found} == {1: 70, 2: None, 3: None}


def test_tcp_accounting(spark):
    # In order, retransmitted, ahead of a gap, and a segment that partly repeats.
    data = [("f", 1, 0, 100), ("f", 2, 100, 50), ("f", 3, 0, 100), ("f", 4, 200, 10), ("f", 5, 205, 20)]
    df = spark.createDataFrame(data, "flow string, t bigint, seq bigint, length bigint")
    row = P.stream_accounting(df, ["flow"], ["t"], "seq", "length", slab=2).first()
    assert (row.segments, row.retransmissions, row.gaps, row.gap_bytes, row.new_bytes) == (5, 1, 1, 50, 175)


def test_fragments(spark):
    data = [
        ("whole", 0, 8, True), ("whole", 8, 8, True), ("whole", 16, 4, False), ("hole", 0, 8, True), ("hole", 16, 4, False),
        ("open", 0, 8, True), ("headless", 8, 8, False),
    ]
    df = spark.createDataFrame(data, "id string, off bigint, len bigint, more boolean")
    found = P.fragment_completeness(df, ["id"], "off", "len", "more", slab=8).collect()
    assert {r.id: bool(r.complete) for r in found} == {"whole": True, "hole": False, "open": False, "headless": False}
