"""Tables whose changes are seen all at once: slices of rows, a list of them per version, and a log of finished versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.store import EpochLog

SLICES = 64


class VersionedTable:
    """Rows dealt into slices by a key; a version lists the folders of each slice.

    An insert adds folders with the new rows only, a removal writes the slices that lose rows anew and no others. Either counts once its
    version is noted; what a write that was killed left behind is never read, and the next write of that version replaces it. Two
    writers at once are not guarded against. Earlier versions stay readable as long as their folders are kept.
    """

    listing = "slice int, version bigint"

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, slices: int = SLICES):
        self.spark, self.path, self.schema, self.key, self.slices = spark, path, schema, key, slices
        self.log = EpochLog(spark, path)

    def version(self) -> int | None:
        state = self.log.read()
        return state.latest if state else None

    def _slice(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.slices)).cast("int")

    def _list(self, version: int | None) -> list[tuple[int, int]]:
        """(slice, version of the folder): at most one entry per slice and insert since it was written anew."""
        if version is None:
            return []
        return [tuple(r) for r in self.spark.read.schema(self.listing).parquet(f"{self.path}/list-{version}").collect()]

    def read(self, version: int | None = None, of_slices: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default, of all slices or of some."""
        listed = self._list(self.version() if version is None else version)
        folders = [f"{self.path}/data-{v}/slice={s}" for s, v in listed if of_slices is None or s in of_slices]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _commit(self, rows: DataFrame, kept: list[tuple[int, int]], version: int) -> None:
        dealt = rows.withColumn("slice", self._slice()).repartition("slice")
        dealt.write.mode("overwrite").partitionBy("slice").parquet(f"{self.path}/data-{version}")
        written = self.spark.read.schema(f"{self.schema}, slice int").parquet(f"{self.path}/data-{version}").select("slice").distinct().collect()
        listed = [*kept, *((r["slice"], version) for r in written)]
        self.spark.createDataFrame(listed, self.listing).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list-{version}")
        self.log.note(version, version)

    def insert(self, rows: DataFrame, id_column: str) -> None:
        """Add the rows whose id the table does not hold yet; rows that repeat an id are one, a null id is never held.

        The id must decide the slice: it is the key, or the key follows from it.
        """
        state = self.version()
        names = [f.split()[0] for f in self.schema.split(", ")]
        missing = F.col(id_column).isNull()
        fresh = rows.select(*names).filter(~missing).dropDuplicates([id_column])
        fresh = fresh.join(self.read(state).select(id_column), id_column, "left_anti").select(*names)
        self._commit(fresh.unionByName(rows.select(*names).filter(missing)), self._list(state), 0 if state is None else state + 1)

    def remove(self, keys: DataFrame) -> int:
        """Take away the rows of the listed keys (a column named as the key); how many slices were written anew."""
        state = self.version()
        if state is None:
            return 0
        asked = keys.select(self.key).distinct()
        hit = self.read(state).join(asked, self.key, "left_semi").select(self._slice().alias("slice")).distinct().collect()
        touched = {r["slice"] for r in hit}
        if not touched:
            return 0
        left = self.read(state, sorted(touched)).join(asked, self.key, "left_anti")
        names = [f.split()[0] for f in self.schema.split(", ")]
        self._commit(left.select(*names), [(s, v) for s, v in self._list(state) if s not in touched], state + 1)
        return len(touched)
