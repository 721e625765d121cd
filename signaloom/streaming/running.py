"""Starting streams and collecting what they wrote."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Longest wait for the report on the end of a stream.
REPORT_SECONDS = 120


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory; required by custom stateful operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait until everything available is processed; a failure of the stream is raised here."""
    query.awaitTermination()
    return query


def run_to_table(
    stream: DataFrame, label: str, output_mode: str = "append", path: str | None = None, state_path: str | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Process what is available now into a table of the shared folder; (the table, the finished query).

    The table is a fresh one, or the one at ``path``, which goes on from ``state_path``.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(output_mode)
        .option("checkpointLocation", state_path or f"{path}-state").trigger(availableNow=True).start(path)
    )
    finish(query)
    return spark.read.schema(stream.schema).parquet(path), query


def run_batches(
    stream: DataFrame,
    label: str,
    handle: Callable[[DataFrame, int], None],
    output_mode: str = "append",
    state_path: str | None = None,
) -> StreamingQuery:
    """Process what is available now, handing each micro-batch to ``handle``; goes on from ``state_path`` if given."""
    state_path = state_path or fresh_path(stream.sparkSession, f"{label}-state")
    return finish(
        stream.writeStream.outputMode(output_mode).foreachBatch(handle)
        .option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )


class _LateRows(StreamingQueryListener):
    """Adds up what every micro-batch reports; a query itself keeps only its latest reports."""

    def __init__(self):
        self.rows: Counter[str] = Counter()
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        with self.changed:
            self.rows[str(event.progress.runId)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, query: StreamingQuery) -> int:
        """Rows of a finished query, once its last report is in."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(query.runId) in self.ended, timeout=REPORT_SECONDS):
                raise TimeoutError(f"no report on the end of stream {query.runId}")
            return self.rows[str(query.runId)]


def run_counting_late(stream: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As :func:`run_to_table`, with the rows dropped for arriving behind the watermark over all micro-batches.

    An aggregation drops after its partial step, so what it counts are groups; a duplicate filter drops rows.
    """
    streams, late = stream.sparkSession.streams, _LateRows()
    streams.addListener(late)
    try:
        found, query = run_to_table(stream, label)
        return found, late.of(query)
    finally:
        streams.removeListener(late)
