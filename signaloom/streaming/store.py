"""State of a stream kept as tables: a log of finished micro-batches, and keyed rows of which each batch writes only its own."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Epochs(NamedTuple):
    """What a reader may see: the latest finished micro-batch, the batch of the latest whole copy (-1: none), the batches
    after that, and the watermark in milliseconds."""

    latest: int
    base: int
    since: tuple[int, ...]
    watermark: int | None


class EpochLog:
    """Finished micro-batches under ``root``. A batch counts from its note on; what an unfinished one wrote is not read."""

    schema = "epoch bigint, base bigint, watermark bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/finished"

    def read(self, before: int | None = None) -> Epochs | None:
        """The state below micro-batch ``before``, None when nothing was finished."""
        try:
            noted = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        noted = noted if before is None else noted.filter(F.col("epoch") < before)
        last = noted.agg(F.max(F.struct("epoch", "base", "watermark")).alias("last")).first()["last"]
        if last is None:
            return None
        since = noted.filter(F.col("epoch") > last["base"]).select("epoch").distinct().collect()  # no more than lie between two copies
        return Epochs(last["epoch"], last["base"], tuple(sorted(r["epoch"] for r in since)), last["watermark"])

    def note(self, epoch: int, base: int, watermark: int | None = None) -> None:
        self.spark.createDataFrame([(epoch, base, watermark)], self.schema).coalesce(1).write.mode("append").parquet(self.path)


class DeltaTable:
    """Rows by key, the latest micro-batch's row of a key counting.

    A batch writes the keys it touched, dealt into ``buckets`` by key; every ``compact_every`` batches a whole copy is written, so a
    reader takes one copy and few deltas. A copy or delta that was noted and is gone raises when it is read.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: str, buckets: int = 16, compact_every: int = 16):
        self.spark, self.path, self.key = spark, path, key
        self.schema = f"{columns}, gone boolean, bucket int"
        self.buckets, self.compact_every = buckets, compact_every

    def _names(self) -> Sequence[str]:
        return [f.split()[0] for f in self.schema.split(", ")]

    def put(self, rows: DataFrame, epoch: int) -> None:
        """Write the rows of the keys that micro-batch ``epoch`` touched; a ``gone`` row takes its key away."""
        rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        kept = rows.withColumn("bucket", bucket).select(*self._names()).repartition("bucket")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/epoch={epoch}")

    def read(self, epochs: Epochs | None, keys: DataFrame | None = None) -> DataFrame:
        """The rows as of ``epochs``, of all keys or of those in ``keys``."""
        names = self._names()
        if epochs is None:
            return self.spark.createDataFrame([], self.schema).drop("gone", "bucket")
        parts = []
        if epochs.since:
            at = f"{self.path}/delta"
            read = self.spark.read.schema(f"{self.schema}, epoch bigint").option("basePath", at)
            parts.append(read.parquet(*[f"{at}/epoch={e}" for e in epochs.since]).select(*names, "epoch"))
        if epochs.base >= 0:
            copy = self.spark.read.schema(self.schema).parquet(f"{self.path}/copy-{epochs.base}")
            parts.append(copy.select(*names, F.lit(epochs.base).cast("bigint").alias("epoch")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if keys is not None:
            asked = keys.select(self.key).distinct()
            bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
            rows = rows.join(asked.withColumn("bucket", bucket), [self.key, "bucket"], "left_semi").select(*names, "epoch")
        values = [n for n in names if n not in (self.key, "bucket")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*values), "epoch").alias("_last"))
        return last.filter(~F.col("_last.gone")).select(self.key, *[f"_last.{v}" for v in values if v != "gone"])

    def compact(self, epochs: Epochs, epoch: int) -> None:
        """Write the whole copy as of micro-batch ``epoch``, which ``epochs`` includes."""
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        whole = self.read(epochs).withColumns({"gone": F.lit(False), "bucket": bucket}).select(*self._names()).repartition("bucket")
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/copy-{epoch}")

    def finish(self, before: Epochs | None, epoch: int) -> int:
        """Make a copy when it is time; the micro-batch of the copy that readers start from."""
        base = before.base if before else -1
        since = (*(before.since if before else ()), epoch)
        if len(since) < self.compact_every:
            return base
        self.compact(Epochs(epoch, base, since, None), epoch)
        return epoch
