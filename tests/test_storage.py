"""Versioned tables, deep pages, documents on two levels, totals with deletes."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from signaloom.operators import filters, reports
from signaloom.session import fresh_path
from signaloom.sources import sinks
from signaloom.sources.tables import VersionedTable
from signaloom.streaming.totals import SignedTotals

BASE = datetime(2024, 1, 1)


def table(spark, **more):
    return VersionedTable(spark, fresh_path(spark, "versioned"), "id bigint, v string", "id", slices=8, **more)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id bigint, v string")


def test_insert_and_remove(spark):
    held = table(spark)
    assert held.version() is None and held.read().count() == 0 and held.remove(rows(spark, (1, "a"))) == 0
    held.insert(rows(spark, *[(k, "a") for k in range(40)], (None, "n")), "id")
    held.insert(rows(spark, (5, "other"), (40, "b"), (40, "b"), (None, "n")), "id")
    assert sorted((r["id"] is None, r["id"] or 0, r["v"]) for r in held.read().collect()) == sorted([(False, k, "a") for k in range(40)] + [(False, 40, "b"), (True, 0, "n"), (True, 0, "n")])
    before = set(Path(held.path).rglob("*.parquet"))
    assert held.remove(rows(spark, (3, ""), (999, ""))) == 1
    left = {r["id"] for r in held.read().collect() if r["id"] is not None}
    assert left == set(range(41)) - {3} and held.version() == 2
    assert 3 in {r["id"] for r in held.read(1).collect()}  # the version before
    slice_of_3 = held.read(1).filter("id = 3").select(held._slice().alias("s")).first()["s"]
    fresh = [p for p in set(Path(held.path).rglob("*.parquet")) - before if "data-2" in str(p)]
    assert fresh and all(f"slice={slice_of_3}" in str(p) for p in fresh)  # no other slice was written


def test_a_killed_write_is_not_seen(spark):
    held = table(spark)
    held.insert(rows(spark, (1, "a"), (2, "b")), "id")
    noted, held.log.note = held.log.note, lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    for attempt in (lambda: held.insert(rows(spark, (9, "z")), "id"), lambda: held.remove(rows(spark, (1, "")))):
        with pytest.raises(RuntimeError, match="killed"):
            attempt()
        assert {r["id"] for r in held.read().collect()} == {1, 2}
    held.log.note = noted
    held.insert(rows(spark, (7, "c")), "id")
    assert {r["id"] for r in held.read().collect()} == {1, 2, 7}


@pytest.mark.parametrize("descending", [True, False])
def test_deep_pages(spark, descending):
    rnd = random.Random(7)
    values = [(k, rnd.choice([None, 0.5, 0.5, 0.5, rnd.random()])) for k in range(3000)]
    frame = spark.createDataFrame(values, "id bigint, v double")
    ordered = sorted(values, key=lambda r: ((r[1] is None) == descending, -(r[1] or 0) if descending else (r[1] or 0), r[0]))
    for number in (1, 60, 75, 149, 150, 151):
        got = filters.page(frame, "v", "id", number=number, descending=descending, far_rows=100).collect()
        assert [r["id"] for r in got] == [r[0] for r in ordered[(number - 1) * 20 : number * 20]]
    few, skipped, _ = filters._ranges_of(frame.filter("v <> 0.5"), "v", descending, 500, 20)
    assert few.count() < 60 and skipped < 40  # only the ranges that the page lies in are sorted


def test_pages_of_texts(spark):
    frame = spark.range(300).selectExpr("id", "lpad(string(id), 4, '0') as v")
    assert [r["id"] for r in filters.page(frame, "v", "id", number=3, descending=False, far_rows=10).collect()] == list(range(40, 60))
    assert filters.page(frame.limit(0), "id", "v", number=9, far_rows=10).count() == 0


def test_master_documents_hold_every_event(spark):
    events = [("m1", s, BASE + timedelta(seconds=10 * s + k), 100 * s + k) for s in range(5) for k in range(7)] + [("m2", 9, BASE, 1)]
    frame = spark.createDataFrame(events, "m string, s bigint, ts timestamp, id bigint")
    heads = spark.createDataFrame([("m1", 35), ("m2", 1), ("m3", 0)], "m string, whole bigint")
    made = sinks.master_documents(heads, frame, "m", "s", ["ts", "id"], ["id"], events_per_piece=3, pieces_per_document=4)
    parts = [json.loads(r["document"]) for r in made.orderBy("m", "part").collect()]
    assert [(p["m"], p["part"], p["whole"], len(p["sessions"])) for p in parts] == [("m1", 0, 35, 4), ("m1", 1, 35, 4), ("m1", 2, 35, 4), ("m1", 3, 35, 3), ("m2", 0, 1, 1)]
    pieces = [s for p in parts[:4] for s in p["sessions"]]
    assert [(s["s"], s["piece"], len(s["events"])) for s in pieces] == [(s, k, n) for s in range(5) for k, n in ((0, 3), (1, 3), (2, 1))]
    assert [e["id"] for s in pieces for e in s["events"]] == [100 * s + k for s in range(5) for k in range(7)]


def test_totals_survive_deletes(spark):
    totals = SignedTotals(spark, ["g"], "v", compact_every=2)
    schema, path = "g string, v bigint, sign int", fresh_path(spark, "signed")
    batches = [
        [("a", 5, 1), ("a", 9, 1), ("a", 9, 1), ("b", 1, 1), (None, None, 1)], [("a", 9, -1), ("b", 1, -1), ("c", 4, -1)], [("a", 9, -1), ("c", 4, 1), ("a", 2, 1)],
    ]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        found = totals.run(spark.readStream.schema(schema).parquet(path))
        seen.append({r["g"]: (r["n"], r["total"], r["least"], r["greatest"]) for r in found.collect()})
    none = {None: (1, None, None, None)}
    assert seen == [
        {"a": (3, 23, 5, 9), "b": (1, 1, 1, 1)} | none, {"a": (2, 14, 5, 9)} | none, {"a": (2, 7, 2, 5)} | none,
    ]


def test_talkers_count_sessions_once(spark):
    frame = spark.createDataFrame([("x", "y", 1, 10), ("x", "y", 1, 20), ("y", "x", 2, 5), ("x", "x", None, 7)], "s string, d string, id bigint, size bigint")
    got = {r["endpoint"]: (r["packets"], r["bytes"], r["sessions"]) for r in reports.talkers(frame, ["s", "d"], "id", "size").collect()}
    assert got == {"x": (5, 49, 2), "y": (3, 35, 2)}
