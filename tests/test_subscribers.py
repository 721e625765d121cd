"""The subscriber registry on hand-made observations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signaloom.operators import subscribers as R

BASE = datetime(2024, 1, 1)
COLUMNS = ("obs_id", "ts", "imsi", "msisdn", "imei", "tmsi", "guti", "ipv4", "ipv6", "tunnel", "confidence")
SCHEMA = "obs_id long, ts timestamp, imsi string, msisdn string, imei string, tmsi long, guti string, ipv4 string, ipv6 string, tunnel string, confidence double"


def seen(spark, *rows):
    made = [{"obs_id": i, "ts": BASE + timedelta(seconds=r.pop("at", i)), "confidence": 1.0, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in made], SCHEMA)


def people(spark, *rows, **more):
    merged, keys = R.merge_subscribers(seen(spark, *rows), "obs_id", "ts", **more)
    return {r["obs_id"]: r["subscriber_id"] for r in merged.collect()}, merged, keys


def test_every_kind_of_identifier_links(spark):
    got, _, _ = people(
        spark, {"imsi": "1", "tmsi": 77}, {"guti": "310260-32769-1-77", "imei": "9"}, {"imei": "9", "ipv6": "2001:db8:1:2:0:0:0:5"},
        {"ipv6": "2001:db8:1:2:0:0:0:6", "tunnel": "10.0.0.1/5"}, {"tunnel": "10.0.0.1/5", "msisdn": "m"}, {"ipv6": "2001:db8:1:3:0:0:0:5"}, {},
    )
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}


def test_an_address_handed_on_parts_two_people(spark):
    rows = [
        {"imsi": "1", "ipv4": "10.0.0.1"}, {"ipv4": "10.0.0.1", "msisdn": "one"}, {"imsi": "2", "ipv4": "10.0.0.1"}, {"ipv4": "10.0.0.1", "msisdn": "two"},
        {"imsi": "1", "ipv4": "10.0.0.1", "imei": "back"},
    ]
    got, merged, keys = people(spark, *rows)
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0}
    probes = seen(spark, {"at": 1, "ipv4": "10.0.0.1"}, {"at": 3, "ipv4": "10.0.0.1"}, {"at": 100, "ipv4": "10.0.0.1"}, {"at": 0, "ipv4": "10.0.0.1", "msisdn": "two"}, {"ipv4": "10.0.0.9"})
    found = R.resolve(probes, "obs_id", "ts", [F.concat(F.lit("msisdn:"), "msisdn"), F.concat(F.lit("ipv4:"), "ipv4")], keys)
    assert {r["obs_id"]: r["subscriber_id"] for r in found.collect()} == {0: 0, 1: 2, 2: 0, 3: 2}


def test_a_value_not_seen_for_long_is_handed_on(spark):
    rows = [{"msisdn": "one", "tmsi": 5, "at": 0}, {"tmsi": 5, "imei": "a", "at": 50}, {"tmsi": 5, "imei": "b", "at": 200}]
    assert people(spark, *[dict(r) for r in rows])[0] == {0: 0, 1: 0, 2: 0}
    assert people(spark, *[dict(r) for r in rows], valid_within_seconds=100)[0] == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("slab", [None, 1_000_000])
def test_hot_address_in_slabs(spark, slab):
    """One address goes round among three people; every observation is theirs who had it last."""
    rows = [{"imsi": str(k // 10 % 3) if k % 10 == 0 else None, "ipv4": "10.0.0.1", "imei": f"d{k // 10 % 3}"} for k in range(300)]
    got, _, _ = people(spark, *rows, slab=slab)
    assert got == {k: 10 * (k // 10 % 3) for k in range(300)}


def test_surest_value_wins(spark):
    rows = [
        {"imsi": "1", "msisdn": "weak", "confidence": 0.4}, {"imsi": "1", "msisdn": "sure", "confidence": 0.9}, {"imsi": "1", "msisdn": "late", "confidence": 0.9},
        {"imsi": "1", "msisdn": "weak", "confidence": 0.5, "guti": "a-b-c-1"}, {"imsi": "1", "guti": "a-b-c-2", "ipv4": "10.0.0.1"},
    ]
    _, merged, _ = people(spark, *rows)
    values = R.attribute_values(merged, ["imsi", "msisdn", "imei", "guti", "tmsi", "ipv4", "ipv6", "tunnel"], F.col("confidence"), "ts")
    weak = [r for r in values.collect() if r["value"] == "weak"]
    assert len(weak) == 1 and weak[0]["confidence"] == 0.5 and weak[0]["observations"] == 2
    (one,) = R.subscriber_table(merged, values, "ts", "obs_id").collect()
    assert (one["msisdn"], one["msisdn_confidence"], one["imei"], one["current_guti"], one["guti_values"]) == ("sure", 0.9, None, "a-b-c-2", 2)
    assert one["completeness"] == pytest.approx(0.8) and one["primary_key"] == "imsi:1" and one["observations"] == 5


def test_bearers_and_coverage(spark):
    _, merged, keys = people(spark, {"imsi": "1", "ipv4": "10.0.0.1"}, {"imsi": "2"})
    messages = spark.createDataFrame(
        [(1, BASE, 5, 6, 9, "1", False), (2, BASE + timedelta(seconds=1), 5, 6, 1, "1", False), (3, BASE, 7, 5, 9, "2", False),
         (4, BASE + timedelta(seconds=9), 7, 5, None, "2", True), (5, BASE, 8, 5, 9, "3", False)],
        "n long, ts timestamp, teid long, ebi int, qci int, imsi string, removes boolean",
    )
    owners = R.resolve(messages, "n", "ts", [F.concat(F.lit("imsi:"), "imsi")], keys)
    bearers = R.bearer_table(messages, owners, "n", ["ts", "n"])
    assert sorted((r["subscriber_id"], r["teid"], r["qci"], r["active"]) for r in bearers.collect()) == [(0, 5, 1, True), (1, 7, 9, False)]
    values = R.attribute_values(merged, ["imsi", "ipv4"], F.lit(1.0), "ts")
    (counts,) = R.coverage(R.subscriber_table(merged, values, "ts", "obs_id"), bearers).collect()
    assert counts.asDict() == {
        "subscribers": 2, "with_imsi": 2, "with_msisdn": 0, "with_imei": 0, "with_guti": 0, "with_address": 1, "with_tunnel": 0, "with_active_bearer": 1,
    }


def test_no_observations(spark):
    merged, keys = R.merge_subscribers(seen(spark, {"imsi": "1"}).limit(0), "obs_id", "ts")
    assert merged.count() == 0 and keys.count() == 0
