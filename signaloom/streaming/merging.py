"""Key-merge correlation over micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import key_nodes, merge_touched
from ..session import cut_lineage, fresh_path
from .running import run_batches
from .store import DeltaTable, EpochLog, Epochs


class OnlineMerge:
    """Stored identifier -> session table, extended by every micro-batch; merged-away ids are kept as a remap.

    A batch writes the identifiers it touched and the ids it merged away, so what it writes follows the batch and not the history;
    an identifier's session is what was written last, followed through the remap. A batch that is run again starts from the
    same state and gives the same one. Finished batches are noted in storage: with a ``root`` of its own a later run goes on where the
    stream stopped, and gives the whole table even when nothing new came. State that was noted and is gone raises.
    """

    def __init__(self, spark: SparkSession, row_id: str, keys: dict[str, Column], root: str | None = None, compact_every: int = 16):
        self.spark, self.row_id, self.keys = spark, row_id, keys
        self.root = root or fresh_path(spark, "merge")
        self.log = EpochLog(spark, self.root)
        self.nodes = DeltaTable(spark, f"{self.root}/nodes", "node", "node string, session_id bigint", compact_every=compact_every)
        self.remap = DeltaTable(spark, f"{self.root}/remap", "merged_id", "merged_id bigint, session_id bigint", compact_every=compact_every)

    def table(self, epochs: Epochs | None, touched: DataFrame | None = None) -> DataFrame:
        """(``node``, ``session_id``) as of a state, of all identifiers or the ``touched`` ones."""
        moved = self.remap.read(epochs).select(F.col("merged_id").alias("session_id"), F.col("session_id").alias("_now"))
        found = self.nodes.read(epochs, touched).join(moved, "session_id", "left")
        return found.select("node", F.coalesce("_now", "session_id").alias("session_id"))

    def handle(self, batch: DataFrame, epoch: int) -> None:
        rows = cut_lineage(batch.select(self.row_id, key_nodes(self.keys).alias("nodes")).filter(F.size("nodes") > 0), "batch")
        before = self.log.read(before=epoch)
        if epoch > 0 and before is None:
            raise ValueError(f"micro-batch {epoch} follows no finished one under {self.root}")
        known = cut_lineage(self.table(before, rows.select(F.explode("nodes").alias("node"))), "known")
        fresh, renamed = merge_touched(rows, known, self.row_id, "nodes")
        self.nodes.put(fresh, epoch)
        renamed = cut_lineage(renamed.filter("_old <> _new").select(F.col("_old").alias("merged_id"), F.col("_new").alias("session_id")), "renamed")
        # ids that had been merged into one that is merged away now point on
        onward = self.remap.read(before).select(F.col("merged_id").alias("_first"), F.col("session_id").alias("merged_id")).join(renamed, "merged_id")
        self.remap.put(renamed.unionByName(onward.select(F.col("_first").alias("merged_id"), "session_id")), epoch)
        base = self.nodes.finish(before, epoch)
        self.remap.finish(before, epoch)
        self.log.note(epoch, base)

    def run(self, stream: DataFrame) -> DataFrame:
        """Process what is available now; (``node``, ``session_id``) afterwards."""
        run_batches(stream, "merge", self.handle, state_path=f"{self.root}/state")
        return self.table(self.log.read())
