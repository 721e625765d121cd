"""Ordered operators over micro-batches: claims, repeats and life cycles, all in DataFrame operations.

Rows (``key, at, id, kind, value``; ``at`` in microseconds) arrive in any order within a delay. Each micro-batch takes the rows that the
watermark has passed, puts the few rows that each of their keys carried over in front of them, and runs the batch operator over
both; rows ahead of the watermark wait in a table. What a key carries over is written for the keys of the batch only. So a stream gives
the rows its batch twin gives, a hot key is cut into slabs as there, and no row passes through Python.

Rows that come after the watermark has passed them are dropped. Every table of a batch counts from its note in the log on, so a batch
that is run again after a failure, or a later run with the same ``root``, goes on from the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import claims_within
from ..operators.timeline import carry_along, fit_slab, previous, running
from ..session import cut_lineage, fresh_path
from .running import run_batches
from .store import DeltaTable, EpochLog

ROW = "key string, at bigint, id bigint, kind string, value string"


def keyed_rows(stream: DataFrame, key: str, ts: str, row_id: str, kind: Column, value: Column | None = None) -> DataFrame:
    """The row shape that ordered streams read; NULL keys, times and kinds are left out and do not move the watermark."""
    shaped = stream.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at"), F.col(row_id).cast("bigint").alias("id"),
        kind.alias("kind"), (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"),
    )
    return shaped.filter("key is not null and at is not null and kind is not null")


def closed(at: Column, watermark_ms: int) -> Column:
    """Whether the watermark has passed a time in microseconds."""
    return F.floor(at / 1000) + 1 <= watermark_ms


class OrderedStream:
    """Base of the ordered operators; ``delay_ms`` is how late a row may come."""

    #: Columns of what a key carries over, and of the results.
    carried_columns = ROW
    result_columns: str

    def __init__(self, spark: SparkSession, delay_ms: int = 600_000, root: str | None = None, compact_every: int = 16):
        self.spark, self.delay_ms = spark, delay_ms
        self.root = root or fresh_path(spark, "ordered")
        self.log = EpochLog(spark, self.root)
        self.carried = DeltaTable(spark, f"{self.root}/carried", "key", self.carried_columns, compact_every=compact_every)

    def step(self, ready: DataFrame, carried: DataFrame, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
        """(results, what the keys carry over) of rows that became final."""
        raise NotImplementedError

    def touched(self, ready: DataFrame, watermark_ms: int, before) -> DataFrame:
        """What the keys of the rows carried over."""
        return self.carried.read(before, ready.select("key"))

    def handle(self, batch: DataFrame, epoch: int) -> None:
        before = self.log.read(before=epoch)
        if epoch > 0 and before is None:
            raise ValueError(f"micro-batch {epoch} follows no finished one under {self.root}")
        passed = before.watermark if before else None
        rows = batch if passed is None else batch.filter(~closed(F.col("at"), passed))
        if before is not None:
            rows = rows.unionByName(self.spark.read.schema(ROW).parquet(f"{self.root}/waiting-{before.latest}"))
        rows = cut_lineage(rows.select("key", "at", "id", "kind", "value"), "rows")
        newest = rows.agg(F.max("at")).first()[0]
        if newest is not None:
            passed = max(newest // 1000 - self.delay_ms, passed if passed is not None else newest // 1000 - self.delay_ms)
        ready = rows.filter(F.lit(False)) if passed is None else rows.filter(closed(F.col("at"), passed))
        waiting = rows if passed is None else rows.filter(~closed(F.col("at"), passed))
        waiting.write.mode("overwrite").parquet(f"{self.root}/waiting-{epoch}")
        carried = cut_lineage(self.touched(ready, passed, before), "carried")
        results, kept = self.step(ready, carried, passed if passed is not None else 0)
        results.write.mode("overwrite").parquet(f"{self.root}/results/epoch={epoch}")
        self.carried.put(kept, epoch)
        self.log.note(epoch, self.carried.finish(before, epoch), passed)

    def results(self) -> DataFrame:
        """What finished micro-batches gave."""
        state = self.log.read()
        if state is None:
            return self.spark.createDataFrame([], self.result_columns)
        found = self.spark.read.schema(f"{self.result_columns}, epoch bigint").parquet(f"{self.root}/results")
        return found.filter(F.col("epoch") <= state.latest).drop("epoch")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process what is available now; all results so far."""
        run_batches(stream, "ordered", self.handle, state_path=f"{self.root}/state")
        return self.results()


def _latest(rows: DataFrame) -> DataFrame:
    """The last row of each key."""
    last = F.max_by(F.struct("at", "id", "kind", "value"), F.struct("at", "id")).alias("_last")
    return rows.groupBy("key").agg(last).select("key", "_last.*")


class LastClaim(OrderedStream):
    """Probes with the value of the latest claim of their key at or before them that is not older than the time to live."""

    result_columns = "key string, probe_id bigint, value string"

    def __init__(self, spark: SparkSession, ttl_us: int, **more):
        super().__init__(spark, **more)
        self.ttl_us = ttl_us

    def step(self, ready, carried, watermark_ms):
        claims = cut_lineage(ready.filter("kind = 'CLAIM'").unionByName(carried), "claims")
        probes = ready.filter("kind <> 'CLAIM'").select("key", F.col("id").alias("probe_id"), "at")
        named = claims.select("key", F.col("at").alias("claimed"), "id", "value")
        found = claims_within(probes, named, ["key"], F.col("at"), F.col("claimed"), "id", self.ttl_us)
        return found.select("key", "probe_id", F.col("claim.value").alias("value")), _latest(claims)


class NearRepeat(OrderedStream):
    """Rows that come no sooner than the given time after the previous row of their key."""

    result_columns = "key string, row_id bigint"

    def __init__(self, spark: SparkSession, within_us: int, **more):
        super().__init__(spark, **more)
        self.within_us = within_us

    def step(self, ready, carried, watermark_ms):
        lined = cut_lineage(ready.withColumn("_new", F.lit(True)).unionByName(carried.withColumn("_new", F.lit(False))), "lined")
        slab = fit_slab(lined, ["key"], "at")
        walked = carry_along(lined, ["key"], ["at", "_new", "id"], slab, before=previous(F.col("at")))
        alone = F.col("before").isNull() | (F.col("at") - F.col("before") > self.within_us)
        return walked.filter(F.col("_new") & alone).select("key", F.col("id").alias("row_id")), _latest(lined.drop("_new"))


class Lifecycle(OrderedStream):
    """Records of entities (tunnels, dialogs): opened at the first row, ended by an END row, by being idle too long or by being
    open longer than ``longest_us``, whatever comes first.

    A life that is still open is carried over as one segment (opening, last row, rows), which counts as the first row of what
    follows. ``silent`` lives, whose key had no row in a batch, end when the watermark passes their end.
    """

    carried_columns = "key string, opened_at bigint, last_at bigint, rows bigint"
    result_columns = "key string, opened_at bigint, last_at bigint, rows bigint, ended_by string"

    def __init__(self, spark: SparkSession, idle_us: int, longest_us: int | None = None, **more):
        super().__init__(spark, **more)
        self.idle_us, self.longest_us = idle_us, longest_us

    def touched(self, ready, watermark_ms, before):
        """All open lives: any of them may have come to its end."""
        return self.carried.read(before)

    def _end(self) -> Column:
        """The last time at which a life may still go on, and what ends it then."""
        idle = F.struct((F.col("last_at") + self.idle_us).alias("until"), F.lit("IDLE").alias("how"))
        if self.longest_us is None:
            return idle
        return F.least(idle, F.struct((F.col("opened_at") + self.longest_us).alias("until"), F.lit("LIMIT").alias("how")))

    def step(self, ready, carried, watermark_ms):
        rows = ready.select("key", "at", "id", (F.col("kind") == "END").alias("ends"), F.col("at").alias("opened_at"), F.lit(1).cast("bigint").alias("n"))
        open_ = carried.select(
            "key", F.col("last_at").alias("at"), F.lit(-1).cast("bigint").alias("id"), F.lit(False).alias("ends"), "opened_at", F.col("rows").alias("n")
        )
        lined = cut_lineage(rows.unionByName(open_), "lined")
        slab = fit_slab(lined, ["key"], "at")
        walked = carry_along(lined, ["key"], ["at", "id"], slab, before=previous(F.struct("at", "ends")))
        parted = F.coalesce(F.col("before.ends") | (F.col("at") - F.col("before.at") > self.idle_us), F.lit(True))
        walked = walked.withColumn("_part", parted.cast("bigint")).drop("before")
        walked = carry_along(walked, ["key"], ["at", "id"], slab, life=running("sum", F.col("_part"))).drop("_part")
        lives = self._lives(walked)
        newest = lives.groupBy("key").agg(F.max("last_at").alias("_newest"))
        lives = cut_lineage(lives.join(newest, "key").withColumn("_end", self._end()), "lives")
        # rows are final up to the watermark: a life is over when a later one began or when no row can come in time
        over = F.col("ended") | (F.col("last_at") < F.col("_newest")) | closed(F.col("_end.until"), watermark_ms)
        done = lives.filter(over).select("key", "opened_at", "last_at", "rows", F.when(F.col("ended"), "END").otherwise(F.col("_end.how")).alias("ended_by"))
        still = lives.filter(~over).select("key", "opened_at", "last_at", "rows", F.lit(False).alias("gone"))
        ended = carried.select("key").join(still.select("key"), "key", "left_anti").select(
            "key", *[F.lit(None).cast("bigint").alias(c) for c in ("opened_at", "last_at", "rows")], F.lit(True).alias("gone")
        )
        return done, still.unionByName(ended)

    def _lives(self, rows: DataFrame) -> DataFrame:
        """Lives of rows that carry their number; where a life is open too long, the rows beyond the limit are the next one."""
        def rolled(part: DataFrame) -> DataFrame:
            return part.groupBy("key", "life").agg(
                F.min("opened_at").alias("opened_at"), F.max("at").alias("last_at"), F.sum("n").alias("rows"), F.bool_or("ends").alias("ended")
            )

        if self.longest_us is None:
            return rolled(rows)
        found, rest = None, rows
        while True:
            openings = rest.groupBy("key", "life").agg(F.min("opened_at").alias("_from"))
            placed = cut_lineage(rest.join(openings, ["key", "life"]), "placed")
            within = F.col("at") <= F.col("_from") + self.longest_us
            part = rolled(placed.filter(within).drop("_from"))
            found = part if found is None else found.unionByName(part)
            # one round for each life that the longest run of rows is cut into; only rows beyond the limit go on
            rest = placed.filter(~within).drop("_from")
            if rest.isEmpty():
                return cut_lineage(found, "cut_lives")
