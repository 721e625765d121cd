"""Joined bindings are dealt by rows, so that a task's share does not grow with the tables."""

from pyspark.sql import functions as F

from signaloom.plans import bindings, registry

SMALL = "/root/testdata/sf0.001"


def shares(frame):
    return [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]


def test_no_task_gets_more_rows_than_it_should(spark, monkeypatch):
    whole = bindings.bound(spark, SMALL, "packets")
    before = sorted(map(tuple, whole.collect()))
    expected = registry.queries()["endpoint_union"](spark, SMALL).collect()
    monkeypatch.setattr(bindings, "ROWS_PER_TASK", 300)
    packets = bindings.bound(spark, SMALL, "packets")
    # twice the mean leaves room for the luck of the hash
    assert max(shares(packets)) <= 2 * 300 < max(shares(whole))
    assert sorted(map(tuple, packets.collect())) == before
    assert sorted(registry.queries()["endpoint_union"](spark, SMALL).collect()) == sorted(expected)


def test_few_rows_are_left_alone(spark):
    tables = {t: bindings.table(spark, SMALL, t) for t in ("lineitem", "orders")}
    assert bindings.dealt(tables, bindings.JOINED_BY["packets"]) is tables
