"""Outbox to index as Structured Streaming: micro-batches, the last operation of a key wins, files are replaced by version.

Each micro-batch writes a whole new version of the index and then its pointer, so a batch that is run again after a crash
leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.sync import latest

MAX_ATTEMPTS = 10


def decide(op: Column, active: Column) -> Column:
    """What to do with an outbox row: an upsert of a generation that is no longer active, or a delete of one that is again, is skipped."""
    return F.when((op == "upsert") & active, "upsert").when((op == "delete") & ~active, "delete").otherwise("skip")


def last_operations(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest(batch, [key], [F.desc(c) for c in order])


def merged(index: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The index after a batch of rows with ``op`` (upsert or delete)."""
    last = last_operations(batch, key, order)
    fresh = last.filter("op = 'upsert'").drop("op")
    if index is None:
        return fresh
    return index.join(last.select(key), key, "left_anti").unionByName(fresh.select(*index.columns))


def retry_state(attempts: Column, failed: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Struct (attempts, state): done, retry or dead after one more try."""
    n = attempts + 1
    return F.struct(n.alias("attempts"), F.when(~failed, "done").when(n >= max_attempts, "dead").otherwise("retry").alias("state"))


class Index:
    """Versions of an index under one folder, of which the last written pointer names the valid one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The largest version whose success mark is there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/_SUCCESS")
        found = self._fs().globStatus(path) or []
        return max((int(s.getPath().getParent().getName()[2:]) for s in found), default=None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.folder}/v={v}")

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={version}")


def drain(stream: DataFrame, index: Index, key: str, order: list[str], checkpoint: str):
    """Start the query that applies ``stream`` (with ``op``) to ``index``; batch n writes version n from the one before it."""

    def apply(batch: DataFrame, n: int) -> None:
        known = index.version()
        if known is not None and known > n:
            return
        before = None if n == 0 else index.read() if known != n else index.spark.read.parquet(f"{index.folder}/v={n - 1}")
        index.write(merged(before, batch, key, order), n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """An extra: tumbling counts with a watermark, for batch and stream alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"))
