"""Processor results made of documents and their lines, each with at most three faults, and the first failure of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import validate
from lectern.plans.registry import LINES, lines, query

#: The fault of a document by id; those behind the first fifteen concern one chunk, number doc_id % chunks.
FAULTS = (
    "RESULT_INVALID", "SOURCE_HASH_MISMATCH", "SOURCE_NOT_VERIFIED", "ENTITY_REF_EMPTY", "ENTITY_REF_DUPLICATE", "ARTIFACT_REF_EMPTY", "ARTIFACT_REF_DUPLICATE",
    "ENTITY_MENTION_CHUNK_UNRESOLVED", "RELATIONSHIP_NO_EVIDENCE", "RELATIONSHIP_EVIDENCE_UNRESOLVED", "LOCATOR_FABRICATED_PAGES", "LOCATOR_CFI_EMPTY", "LOCATOR_PAGE_SOURCE_INCONSISTENT", "CHUNK_IMAGE_REF_UNRESOLVED", "",
    "CHUNK_INDEX_NONCONTIGUOUS", "CHUNK_EMPTY", "CHUNK_REF_EMPTY", "CHUNK_REF_DUPLICATE", "DENSE_DIM_MISMATCH", "DENSE_DIM_VALUES", "DENSE_NON_FINITE", "SPARSE_KEY_EMPTY", "SPARSE_VALUE_INVALID",
    "LOCATOR_MISSING", "LOCATOR_PAGE_SOURCE_MISSING", "LOCATOR_PAGE_SOURCE_UNKNOWN", "LOCATOR_TYPE_UNKNOWN",
)
_LISTED = "[" + ", ".join(f"'{x}'" for x in FAULTS) + "]"


def _results(spark, sf_dir):
    """(doc_id, result, frozen): the lines of a document that aren't blank are its chunks."""
    d = F.col("doc_id")
    fault = F.get(F.array(*map(F.lit, FAULTS)), (d % len(FAULTS)).cast("int"))
    has = lambda *names: F.col("fault").isin(*names)
    kept = lines(spark, sf_dir).filter("trim(text) <> ''").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("texts"))
    made = kept.withColumn("fault", fault).withColumn("hit", (d % F.size("texts")).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)

    def chunk(text, i):
        here = F.col("hit") == i
        bad = lambda name: here & has(name)
        size = F.when(bad("DENSE_DIM_MISMATCH"), 3).otherwise(2)
        values = F.when(bad("DENSE_DIM_VALUES"), F.array(F.lit(1.0))).when(bad("DENSE_NON_FINITE"), F.array(F.lit(1.0), F.lit(float("inf")))).when(bad("DENSE_DIM_MISMATCH"), F.array(*[F.lit(1.0)] * 3)).otherwise(F.array(F.lit(0.5), F.lit(0.5)))
        cfi = has("LOCATOR_CFI_EMPTY", "LOCATOR_PAGE_SOURCE_INCONSISTENT")
        source = F.when(bad("LOCATOR_PAGE_SOURCE_MISSING"), "").when(bad("LOCATOR_PAGE_SOURCE_UNKNOWN"), "guessed").when(has("LOCATOR_CFI_EMPTY"), "none").otherwise("blind")
        locator = F.struct(
            F.when(cfi, "epub_cfi").when(bad("LOCATOR_TYPE_UNKNOWN"), "line").otherwise("page_span").alias("type"), source.alias("page_source"),
            F.when(here & has("LOCATOR_CFI_EMPTY"), "").otherwise("/2").alias("cfi_start"), F.lit("/4").alias("cfi_end"),
        )
        return F.struct(
            F.when(bad("CHUNK_INDEX_NONCONTIGUOUS"), i + 1).otherwise(i).alias("index"), F.when(bad("CHUNK_EMPTY"), " ").otherwise(text).alias("text"),
            F.when(bad("CHUNK_REF_EMPTY"), "").when(bad("CHUNK_REF_DUPLICATE"), "c0").otherwise(F.concat(F.lit("c"), i)).alias("ref"),
            F.when(bad("CHUNK_IMAGE_REF_UNRESOLVED"), F.array(F.lit("a1"), F.lit("lost"))).otherwise(F.array(F.lit("a0"))).alias("image_refs"),
            F.struct(size.alias("dimensions"), values.alias("values")).alias("dense"),
            F.when(bad("SPARSE_KEY_EMPTY"), F.create_map(F.lit(""), F.lit("1"))).when(bad("SPARSE_VALUE_INVALID"), F.create_map(F.lit("a"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.lit("0.5"))).alias("sparse"),
            F.when(~bad("LOCATOR_MISSING"), locator).alias("locator"),
        )

    def two(kind, empty, repeated):
        return F.when(has(empty), "").when(has(repeated), kind + "0").otherwise(kind + "1")

    mention = F.when(has("ENTITY_MENTION_CHUNK_UNRESOLVED"), "gone").otherwise("c0")
    entities = F.array(F.struct(F.lit("e0").alias("ref"), F.array(F.lit("c0")).alias("mentions")), F.struct(two("e", "ENTITY_REF_EMPTY", "ENTITY_REF_DUPLICATE").alias("ref"), F.array(mention).alias("mentions")))
    artifacts = F.array(F.struct(F.lit("a0").alias("ref")), F.struct(two("a", "ARTIFACT_REF_EMPTY", "ARTIFACT_REF_DUPLICATE").alias("ref")))
    shown = F.when(has("RELATIONSHIP_NO_EVIDENCE"), F.array().cast("array<string>")).when(has("RELATIONSHIP_EVIDENCE_UNRESOLVED"), F.array(F.lit("gone"))).otherwise(F.array(F.lit("c0")))
    relations = F.array(F.struct(F.lit("sequential_next").alias("type"), F.array().cast("array<string>").alias("evidence")), F.struct(F.lit("part_of").alias("type"), shown.alias("evidence")))
    told = F.size("texts") + F.when(d % 3 == 0, 1).otherwise(0)
    result = F.struct(
        F.struct(F.when(d % 17 == 0, "other").otherwise("own").alias("attachment_id"), F.when(has("SOURCE_HASH_MISMATCH"), "sha256:ff").otherwise("sha256:aa").alias("content_hash"), (~has("SOURCE_NOT_VERIFIED")).alias("verified")).alias("source"),
        F.transform("texts", chunk).alias("chunks"), entities.alias("entities"), artifacts.alias("artifacts"), relations.alias("entity_relationships"), none(validate.RELATION).alias("chunk_relationships"),
        F.struct(told.alias("chunks"), F.lit(2).alias("entities"), F.lit(2).alias("artifacts"), F.lit(2).alias("entity_relationships"), F.lit(0).alias("chunk_relationships")).alias("stats"),
    )
    epub = has("LOCATOR_FABRICATED_PAGES", "LOCATOR_CFI_EMPTY", "LOCATOR_PAGE_SOURCE_INCONSISTENT")
    frozen = F.struct(F.lit("own").alias("attachment_id"), F.lit("aa").alias("content_hash"), F.when(epub, validate.EPUB).otherwise("application/pdf").alias("content_type"))
    return made.select("doc_id", F.when(~has("RESULT_INVALID"), result).alias("result"), frozen.alias("frozen"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines WHERE trim(text) <> '' GROUP BY doc_id),
f AS (SELECT *, ({_LISTED})[doc_id % {len(FAULTS)} + 1] AS fault FROM n)
SELECT doc_id, CASE WHEN fault = 'RESULT_INVALID' THEN fault WHEN doc_id % 17 = 0 THEN 'SOURCE_IDENTITY_MISMATCH' WHEN fault <> '' AND (fault <> 'CHUNK_REF_DUPLICATE' OR doc_id % n > 0) THEN fault
WHEN doc_id % 3 = 0 THEN 'STATS_MISMATCH' END AS code FROM f""")
def result_failures(spark, sf_dir):
    """The first failure of every document's result, by the order of the checks."""
    return _results(spark, sf_dir).select("doc_id", validate.first_failure(F.col("result"), F.col("frozen"), 2).alias("code"))
