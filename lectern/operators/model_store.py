"""The graph's read model as stored tables: families, roots and triples, refreshed by what changed, and swapped by a pointer.

A refresh finds the roots reached by the changed entities, before and after, recomputes their families and every triple that ends at
one of them, and applies these as a batch to three bucketed indexes, which rewrite the touched buckets only. The pointer is written when
all three are; readers follow it, so they see one version of all. A refresh that broke off is repeated as a whole: the parts that are
done stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.streaming.bucket_index import BucketIndex

#: A stored row says each name once: a member its root only if that is another, a triple its ends and type as its key.
KEYS = {"members": "id", "roots": "root", "triples": "key"}


def _packed(part: str, rows: DataFrame) -> DataFrame:
    if part == "members":
        return rows.select("id", F.when(F.col("root") != F.col("id"), F.col("root")).alias("other"))
    if part == "triples":
        return rows.select(F.struct("lo", "hi", "type").alias("key"), (F.col("source") == F.col("lo")).alias("fwd"), *[c for c in rows.columns if c not in ("lo", "hi", "type", "source", "target")])
    return rows


def _unpacked(part: str, rows: DataFrame) -> DataFrame:
    if part == "members":
        return rows.select("id", F.coalesce("other", "id").alias("root"))
    if part == "triples":
        ends = F.when(F.col("fwd"), F.col("lo")).otherwise(F.col("hi")).alias("source"), F.when(F.col("fwd"), F.col("hi")).otherwise(F.col("lo")).alias("target")
        return rows.select("key.*", *[c for c in rows.columns if c != "key"]).select("lo", "hi", "type", *ends, *[c for c in rows.columns if c not in ("key", "fwd")])
    return rows


class ModelStore:
    """A read model below ``folder``; ``buckets`` a table."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.parts = {name: BucketIndex(spark, f"{self.folder}/{name}", key, [], buckets) for name, key in KEYS.items()}
        self.pointer = BucketIndex(spark, f"{self.folder}/pointer", "name", [], 1)

    def version(self) -> int | None:
        known = self.pointer.versions()
        return known[-1] if known else None

    def read(self, part: str) -> DataFrame | None:
        """members (id, root), roots or triples of the current version; None if there are no rows."""
        version = self.version()
        found = None if version is None else self.parts[part].read(version)
        return None if found is None else _unpacked(part, found.drop("bucket"))

    def refresh(self, entities: DataFrame, mentions: DataFrame, relations: DataFrame, chunks: DataFrame, changed: DataFrame | None = None) -> int:
        """Bring the model up to date, as the next version; ``changed``: the ids of entities that came, went, or whose form, type, binding,
        mentions or relations differ (one end of a relation is enough). Without it, or the first time, everything is computed."""
        version = self.version()
        after = -1 if version is None else version
        old = {name: self.read(name) for name in self.parts}
        members = entities.select("id", F.coalesce("alias_of", "id").alias("root"))
        reached = None
        if changed is not None and old["members"] is not None:
            both = members.unionByName(old["members"].select("id", "root"))
            reached = both.join(changed.select("id").distinct(), "id", "left_semi").select("root").distinct()
            reached = self._kept(reached, f"reached/v={after + 1}")
            entities = entities.withColumn("root", F.coalesce("alias_of", "id"))
            families = self._kept(entities.join(reached, "root", "left_semi").select(*entities.columns), f"families/v={after + 1}")
            fresh = self._computed(entities, mentions, relations, chunks, families)
        else:
            fresh = self._computed(entities, mentions, relations, chunks)
        for name, part in self.parts.items():
            batch = _packed(name, fresh[name]).withColumn("op", F.lit("upsert"))
            if old[name] is not None:
                gone = self._reached(old[name], name, reached)  # of a key's operations the upsert counts
                batch = batch.unionByName(gone.withColumn("op", F.lit("delete")), allowMissingColumns=True)
            part.apply(batch, after + 1)
        self.pointer.apply(self.spark.sql("SELECT 'model' AS name, 'upsert' AS op"), after + 1)
        return after + 1

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _reached(rows: DataFrame, part: str, reached: DataFrame | None) -> DataFrame:
        """The keys of a stored part's rows that end at a reached root."""
        if part != "triples":
            keys = rows.select({"members": ["id", "root"], "roots": ["root"]}[part])
            return (keys if reached is None else keys.join(reached, "root", "left_semi")).select(KEYS[part])
        keys = rows.select("lo", "hi", "type")
        if reached is not None:
            for end in ("lo", "hi"):
                keys = keys.join(reached.select(F.col("root").alias(end), F.lit(True).alias(f"at_{end}")), end, "left")
            keys = keys.filter("at_lo OR at_hi")
        return keys.select(F.struct("lo", "hi", "type").alias("key"))

    def _computed(self, entities: DataFrame, mentions: DataFrame, relations: DataFrame, chunks: DataFrame, families: DataFrame | None = None) -> dict[str, DataFrame]:
        """The parts' rows; with ``families`` (entities with their root) theirs only, and the triples that end there."""
        if families is not None:
            near, own = families.select("id", "root"), families.select("id")
            held = mentions.join(own.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
            if "doc_id" in relations.columns and "doc_id" in entities.columns:  # both ends are looked up at once
                ids = families.groupBy("doc_id").agg(F.collect_set("id").alias("ids"))
                touching = relations.join(ids, "doc_id").filter(F.array_contains("ids", F.col("source")) | F.array_contains("ids", F.col("target")))
            else:
                touching = relations
                for end in ("source", "target"):
                    touching = touching.join(own.select(F.col("id").alias(end), F.lit(True).alias(f"at_{end}")), end, "left")
                touching = touching.filter("at_source OR at_target")
            touching = touching.select(*relations.columns)
        else:
            near, touching, families, held = entities.select("id", F.coalesce("alias_of", "id").alias("root")), relations, entities, mentions
        model = graph.read_model(entities, touching, chunks)
        return {"members": near, "roots": graph.roots(families, held), "triples": model}
