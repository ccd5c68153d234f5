"""Snapshots with one active generation: write aside, check counts, then move a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Tables of a generation under folder/generation/table; folder/ACTIVE/n names generations in order, the last is active."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def persist(self, generation: str, tables: dict[str, DataFrame], expected: dict[str, int]) -> None:
        """Write all tables, count them again, and only then make the generation active; a failed check leaves the old one."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{generation}/{name}")
        counts = {name: self.spark.read.parquet(f"{self.folder}/{generation}/{name}").count() for name in tables}
        wrong = {n: (counts[n], expected[n]) for n in expected if counts.get(n) != expected[n]}
        if wrong:
            raise ValueError(f"rows written differ from rows validated: {wrong}")
        log = self._log()
        row = json.dumps({"n": len(log), "generation": generation})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/ACTIVE/{len(log):09d}")

    def _log(self) -> list[dict]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ACTIVE/*/_SUCCESS")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.globStatus(hadoop):
            return []
        rows = self.spark.read.text(f"{self.folder}/ACTIVE/*").collect()  # one row a generation
        return sorted((json.loads(r["value"]) for r in rows), key=lambda r: r["n"])

    def active(self) -> str | None:
        log = self._log()
        return log[-1]["generation"] if log else None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.active()}/{name}")


def archive_superseded(archive: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append (survivor, loser, operation, ...), each once; what is there already stays as it is."""
    keys = ["survivor", "loser", "operation"]
    return archive.unionByName(fresh.dropDuplicates(keys).join(archive.select(*keys), keys, "left_anti").select(*archive.columns))


def post_insert_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, n) of all tables in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
