"""Running statistics over inserts and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path
from .running import run_batches
from .store import DeltaTable, EpochLog


class SignedTotals:
    """Count, sum, least and greatest value per group of a stream of signed rows: ``sign`` is 1 for an insert and -1 for a delete.

    What is stored is how often each value of a group is there. A micro-batch folds its rows to one change per group and value, reads
    those and writes them back, so what it writes follows the batch; a value whose count comes to zero goes, and the least and greatest are those
    of what is left. The order of an insert and its delete does not matter.
    """

    columns = "member string, grp string, value bigint, n bigint"

    def __init__(self, spark: SparkSession, by: Sequence[str], value: str, sign: str = "sign", root: str | None = None, compact_every: int = 16):
        self.spark, self.by, self.value, self.sign = spark, list(by), value, sign
        self.root = root or fresh_path(spark, "totals")
        self.log = EpochLog(spark, self.root)
        self.counts = DeltaTable(spark, f"{self.root}/counts", "member", self.columns, compact_every=compact_every)

    def handle(self, batch: DataFrame, epoch: int) -> None:
        before = self.log.read(before=epoch)
        if epoch > 0 and before is None:
            raise ValueError(f"micro-batch {epoch} follows no finished one under {self.root}")
        group = F.to_json(F.struct(*self.by), {"ignoreNullFields": "false"})
        rows = batch.select(group.alias("grp"), F.col(self.value).cast("bigint").alias("value"), F.col(self.sign).cast("bigint").alias("sign"))
        member = F.concat_ws("|", F.coalesce(F.col("value").cast("string"), F.lit("null")), "grp")
        change = rows.groupBy("grp", "value").agg(F.sum("sign").alias("change")).withColumn("member", member)
        change = cut_lineage(change, "change")
        held = self.counts.read(before, change).select("member", F.col("n").alias("held"))
        n = F.col("change") + F.coalesce("held", F.lit(0))
        changed = change.join(held, "member", "left").select("member", "grp", "value", n.alias("n"), (n == 0).alias("gone"))
        self.counts.put(changed, epoch)
        self.log.note(epoch, self.counts.finish(before, epoch))

    def totals(self) -> DataFrame:
        """Per group with any row left: the columns of the group, ``n, total, least, greatest``; a null value counts as a row only."""
        kinds = ", ".join(f"{c} string" for c in self.by)
        summed = self.counts.read(self.log.read()).groupBy("grp").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest")
        )
        named = summed.withColumn("grp", F.from_json("grp", kinds))
        return named.filter("n > 0").select("grp.*", "n", "total", "least", "greatest")

    def run(self, stream: DataFrame) -> DataFrame:
        run_batches(stream, "totals", self.handle, state_path=f"{self.root}/state")
        return self.totals()
