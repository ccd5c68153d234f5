"""An index in buckets of keys: a micro-batch rewrites the buckets that it touches, and a manifest says which files are valid.

A key belongs to the bucket of its hash. Batch n writes the touched buckets below ``data/v=n/bucket=b`` and then the manifest
``manifest/v=n``, one row a bucket with the version that holds it; the manifest's success mark is the commit. A batch that is run again
finds its manifest and does nothing, or, if it broke off before, overwrites its own files. Readers see one manifest's files. ``clean`` removes what the
last manifests don't name. The driver holds the manifest: at most as many rows as there are buckets.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GONE = -1


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once below ``shared_dir`` and read from there, however often it is used after."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketIndex:
    """Rows by ``key`` below ``folder``, in ``buckets`` parts. Of a batch's operations on a key the last in ``order`` counts, of equal ones the greatest row."""

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], buckets: int = 256):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets

    def _paths(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        self._fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath() for s in self._fs.globStatus(path) or []]

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        return sorted(int(p.getParent().getName()[2:]) for p in self._paths("manifest/v=*/_SUCCESS"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """bucket -> version of its files, as of ``version`` (the last one)."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/manifest/v={known[-1] if version is None else version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(held.items()) if v != GONE]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a committed version, the last one if none is named; None before the first and if nothing is left."""
        return self._read(self.manifest(version))

    def _dealt(self) -> dict:
        """A key's bucket, and a part of it, so that a bucket isn't one task's work where there are more tasks than buckets."""
        parts = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets))
        return {"bucket": F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"), "_part": F.pmod(F.hash(self.key), F.lit(parts))}

    def apply(self, batch: DataFrame, n: int) -> None:
        """Apply ``batch`` (rows with ``op``: upsert, delete or skip) as version ``n``; versions that are there already stay as they are."""
        done = self.versions()
        if done and done[-1] >= n:
            return
        held = self.manifest()
        dealt = self._dealt()
        columns = [c for c in batch.columns if c != "op"]
        asked = batch.filter("op IN ('upsert', 'delete')").withColumns(dealt).repartition(*dealt)
        last = asked.groupBy(*dealt, self.key).agg(F.max_by(F.struct("op", *columns), F.struct(*self.order, F.struct("op", *columns))).alias("row")).select("bucket", "row.*")
        path, touched = f"{self.folder}/data/v={n}", set()
        if held:
            last.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch/v={n}")  # reduced once, however often it is read below
            touched = {int(p.getName().split("=")[1]) for p in self._paths(f"batch/v={n}/bucket=*")}
            last = self.spark.read.schema(last.schema).parquet(f"{self.folder}/batch/v={n}").select("op", *columns, "bucket")
            before = self._read({b: held[b] for b in touched if b in held})
            if before is not None:
                both = last.drop("bucket").unionByName(before.select(F.lit("held").alias("op"), *columns)).withColumns(dealt).repartition(*dealt)
                named = F.max(F.col("op") != "held").over(W.partitionBy(*dealt, self.key))
                last = both.withColumn("_named", named).filter("op = 'upsert' OR NOT _named").drop("_named", "_part").withColumn("op", F.lit("upsert"))
        last.filter("op = 'upsert'").drop("op").write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = {int(p.getName().split("=")[1]) for p in self._paths(f"data/v={n}/bucket=*")}
        held |= {b: n if b in there else GONE for b in touched | there}
        rows = self.spark.createDataFrame(sorted(held.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={n}")

    def clean(self, keep: int = 2) -> int:
        """Remove batches and files that the last ``keep`` manifests don't name, and older manifests; returns how many folders went."""
        known = self.versions()
        kept = known[-keep:]
        named = {(b, v) for k in kept for b, v in self.manifest(k).items()}
        stale = [p for p in self._paths("data/v=*/bucket=*") if kept and (int(p.getName()[7:]), int(p.getParent().getName()[2:])) not in named and int(p.getParent().getName()[2:]) <= known[-1]]
        stale += [p for p in self._paths("manifest/v=*") if kept and int(p.getName()[2:]) < kept[0]]
        stale += [p for p in self._paths("batch/v=*") if known and int(p.getName()[2:]) <= known[-1]]
        for p in stale:
            self._fs.delete(p, True)
        return len(stale)


def drain(stream: DataFrame, index: BucketIndex, checkpoint: str):
    """Start the query that applies ``stream`` (with ``op``) to ``index``, a version a micro-batch."""
    return stream.writeStream.foreachBatch(index.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
