"""Work that waits for quiet: bursts of events by key become sessions, and a session that no late event can extend starts one run.

Sessions are Spark's session windows with a watermark; local merging keeps a burst's events from meeting in one task one by
one. Each micro-batch with closed sessions runs the action once for them and records them as a version of the ledger; a batch that is
repeated after a crash finds its version and runs nothing. A crash between the action and the ledger repeats the action, which must
therefore be one that changes nothing the second time, as consolidation does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, first, until, events) of bursts: a gap of that length ends one; ``until`` is its last event plus the gap."""
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    held = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return held.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "events")


class Debounced:
    """Runs ``action`` for closed sessions, once a session; the ledger of runs is below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, action: Callable[[DataFrame], None]):
        self.spark, self.folder, self.action = spark, folder.rstrip("/"), action

    def _done(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return [str(s.getPath().getParent()) for s in found]

    def apply(self, closed: DataFrame, n: int) -> None:
        if self._done(f"v={n}"):
            return
        closed = closed.persist()
        try:
            if not closed.isEmpty():
                self.action(closed)
                closed.write.mode("overwrite").parquet(f"{self.folder}/v={n}")
        finally:
            closed.unpersist()

    def runs(self) -> DataFrame | None:
        """The sessions that ran, with the batch that ran them; None before the first."""
        done = self._done("v=*")
        if not done:
            return None
        return self.spark.read.parquet(*done).withColumn("batch", F.regexp_extract(F.input_file_name(), "/v=([0-9]+)/", 1).cast("long"))

    def start(self, events: DataFrame, time: str, key: str, gap: str, late: str, checkpoint: str) -> StreamingQuery:
        """Start the query over all that is there now."""
        closed = sessions(events, time, key, gap, late)
        return closed.writeStream.outputMode("append").foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
