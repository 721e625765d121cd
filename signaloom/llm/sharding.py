"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record hashes into one of ``SLOTS`` virtual slots, whatever the number of shards. Bytes and rows are summed per slot,
and a map says which shard holds each slot. Rebalancing edits the map: it moves whole slots off shards that hold more
than their share, as few as that takes, and stores the result as a new version; earlier versions stay readable. So the
only things that ever reach the driver are the sums of a fixed number of slots, and adding a shard moves only the slots that
the new shard takes.

A slot is the grain of the balance. A slot that alone holds more than ``1 / SPLIT_SHARE`` of a shard's share (one record
repeated over and over, which any hash puts in one place) is dealt row by row to ``SPLITS`` slots of its own; there are
at most ``shards * SPLIT_SHARE`` of these, whatever the input. One record is never cut, so shards are near equal as far as no
single record is larger than that.

Records are told apart by id and text; a null id or text counts as one more value, with no bytes. Rows that are
equal in both may change places among themselves. Extra columns play no part. An empty table gets the first map and no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaloom.session import cut_lineage

from .common import column

SLOTS = 16_384
SPLITS = 256
SPLIT_SHARE = 8
#: How far above its equal share a shard may be before slots leave it.
TOLERANCE = 0.0005
MAP_SCHEMA = "vslot long, shard int"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one for the record."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def first_map(slots: int, shards: int) -> dict[int, int]:
    """Slots dealt to the shards in turn."""
    return {slot: slot % shards for slot in range(slots)}


def rebalance(placed: Mapping[int, int], weights: Mapping[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The map with slots moved until no shard is above its share, where slots small enough exist.

    Shards above the share give up their heaviest slots that fit the surplus; these go, heaviest first, to the shard with
    the least, as do slots of shards that no longer exist and slots not yet in the map. Then single slots go from the
    fullest shard to the emptiest while that brings the two closer. Where the only change is that shards were added, slots
    move to the added shards alone.
    """
    mean = sum(weights.values()) / shards
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    loose: list[tuple[int, int]] = []
    for slot in sorted(set(placed) | set(weights)):
        weight, shard = weights.get(slot, 0), placed.get(slot, shards)
        if shard < shards:
            load[shard] += weight
            held[shard].append((weight, slot))
        else:
            loose.append((weight, slot))
    added = set(range(shards)) - set(placed.values())
    takers = sorted(added) if added and not loose else list(range(shards))
    limit = mean * (1 + tolerance)
    for shard in range(shards):
        for weight, slot in sorted(held[shard], key=lambda x: (-x[0], x[1])):
            if load[shard] <= limit:
                break
            if 0 < weight <= load[shard] - mean:
                load[shard] -= weight
                loose.append((weight, slot))
    out = {s: p for s, p in placed.items() if p < shards}
    least = [(load[shard], shard) for shard in takers]
    heapq.heapify(least)
    for weight, slot in sorted(loose, key=lambda x: (-x[0], x[1])):
        n, shard = heapq.heappop(least)
        out[slot] = shard
        heapq.heappush(least, (n + weight, shard))
    for n, shard in least:
        load[shard] = n
    _even_out(out, weights, load, takers, mean * tolerance)
    return out


def _even_out(placed: dict[int, int], weights: Mapping[int, int], load: list[int], takers: Sequence[int], tolerance: float) -> None:
    held: list[list[tuple[int, int]]] = [[] for _ in load]
    for slot, shard in placed.items():
        if weights.get(slot):
            insort(held[shard], (weights[slot], slot))
    for _ in range(len(placed)):
        fullest, emptiest = max(range(len(load)), key=load.__getitem__), min(takers, key=load.__getitem__)
        apart = load[fullest] - load[emptiest]
        at = bisect_left(held[fullest], (apart / 2, -1))
        near = [x for x in held[fullest][max(0, at - 1) : at + 1] if x[0] < apart]
        if apart <= tolerance or not near:
            return
        best = min(near, key=lambda x: (abs(apart - 2 * x[0]), x))
        held[fullest].remove(best)
        insort(held[emptiest], best)
        placed[best[1]] = emptiest
        load[fullest] -= best[0]
        load[emptiest] += best[0]


def store_map(spark: SparkSession, path: str, placed: Mapping[int, int], version: int) -> None:
    """Write a version; a version that is there already is an error, so two editors cannot both make the same one."""
    rows = pd.DataFrame({"vslot": list(placed.keys()), "shard": list(placed.values())})
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{version:08d}")


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions under ``path``, rising."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath() for s in files.listStatus(folder)]
    return sorted(int(p.getName()) for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """A version of the map, the latest by default."""
    if version is None:
        version = stored_versions(spark, path)[-1]
    return {r["vslot"]: r["shard"] for r in spark.read.schema(MAP_SCHEMA).parquet(f"{path}/{version:08d}").collect()}


def _slot_sums(records: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each slot that holds any: at most as many entries as there are slots."""
    summed = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {r["vslot"]: (r["bytes"], r["n"]) for r in summed.collect()}


def slotted(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS,
) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Written rows (``id, size, text_crc32, vslot, row``) and the sums per slot, heavy slots dealt row by row."""
    identity, text = column(docs, id_column), column(docs, text_column)
    records = docs.select(
        identity.alias("id"), record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(identity, text).alias("hash"),
    )
    records = records.withColumn("row", F.monotonically_increasing_id())
    records = cut_lineage(records.withColumn("vslot", F.pmod("hash", F.lit(slots))).drop("hash"), "records")
    sums = _slot_sums(records)
    total, rows = (sum(x[k] for x in sums.values()) for k in (0, 1))
    most = [max(1, n / (shards * SPLIT_SHARE)) for n in (total, rows)]
    heavy = sorted(s for s, (size, n) in sums.items() if n > 1 and (size > most[0] or n > most[1]))
    if not heavy:
        return records, sums
    base = F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate(heavy) for x in (s, slots + n * SPLITS)]), F.col("vslot"))
    dealt = base + F.pmod(F.xxhash64("row"), F.lit(SPLITS))
    split = records.withColumn("vslot", F.when(F.col("vslot").isin(heavy), dealt).otherwise(F.col("vslot")))
    again = _slot_sums(split.filter(F.col("vslot") >= slots))
    return split, {s: x for s, x in sums.items() if s not in set(heavy)} | again


def shard_records(
    docs: DataFrame, path: str, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size, text_crc32, shard, slot, vslot, map_version``.

    The latest map under ``path`` (the first one, if there is none) is edited to balance the bytes of these records and
    stored as the next version, unless nothing has to move. ``slot`` is the record's place in its shard, from 0 without gaps:
    by virtual slot, then id, content and size.
    """
    spark = docs.sparkSession
    records, sums = slotted(docs, shards, id_column, text_column, slots)
    versions = stored_versions(spark, path)
    if not versions:
        store_map(spark, path, first_map(slots, shards), 0)
        versions = [0]
    before = load_map(spark, path, versions[-1])
    placed = rebalance(before, {s: size for s, (size, _) in sums.items()}, shards)
    version = versions[-1]
    if placed != before:
        version += 1
        store_map(spark, path, placed, version)
    return _placed(records, placed, sums, shards).select(
        F.col("id").alias(id_column), "size", "text_crc32", "shard", "slot", "vslot", F.lit(version).alias("map_version")
    )


def _placed(records: DataFrame, placed: Mapping[int, int], sums: Mapping[int, tuple[int, int]], shards: int) -> DataFrame:
    ahead: Sequence[int] = [0] * shards
    rows = []
    for slot in sorted(sums):
        shard = placed[slot]
        rows.append((slot, shard, ahead[shard]))
        ahead[shard] += sums[slot][1]
    # one row per slot in use, and slots are fixed in number: small enough to broadcast at any size of the input
    table = records.sparkSession.createDataFrame(rows, "vslot long, shard int, ahead long")
    place = F.expr("row_number() over (partition by vslot order by id, text_crc32, size, row)")
    return records.withColumn("place", place).join(F.broadcast(table), "vslot").withColumn("slot", F.col("ahead") + F.col("place") - 1)
