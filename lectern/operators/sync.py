"""Library synchronisation: guarded merges, deletions, membership, selections, job creation, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order, which must end in a unique column."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """``stored`` with the rows of ``batch`` whose version isn't older; within the batch the newest wins, then the largest tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("_new"), F.desc(tie)]).drop("_new")


def advance_cursor(stored: Column, seen: Column) -> Column:
    """A cursor never moves back."""
    return F.greatest(F.coalesce(stored, F.lit(0)), F.coalesce(seen, F.lit(0)))


def deleted_keys(trash: DataFrame, removed: DataFrame) -> DataFrame:
    return trash.unionByName(removed).distinct()


def apply_deletes(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """``items`` (key, parent_key, deleted) with deletions of keys, which reach their children."""
    marks = deleted.select(F.col("key").alias("_k"), F.lit(True).alias("_d")).distinct()
    own = items.join(marks, items["key"] == marks["_k"], "left").drop("_k").withColumnRenamed("_d", "_own")
    parents = marks.withColumnRenamed("_d", "_up")
    both = own.join(parents, own["parent_key"] == parents["_k"], "left").drop("_k")
    return both.withColumn("deleted", F.col("deleted") | F.coalesce("_own", "_up", F.lit(False))).select(*items.columns)


def mark_missing(stored: DataFrame, batch_keys: DataFrame, key: str, full_snapshot: bool) -> DataFrame:
    """``stored`` with ``missing``: not in the batch; only a full snapshot can tell."""
    if not full_snapshot:
        return stored.withColumn("missing", F.lit(False))
    return stored.join(batch_keys.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").withColumn("missing", F.col("_seen").isNull()).drop("_seen")


def memberships(items: DataFrame) -> DataFrame:
    """(collection_key, item_key), each once, from ``items``: key, collections."""
    return items.select(F.explode("collections").alias("collection_key"), F.col("key").alias("item_key")).distinct()


def preferred_attachment(attachments: DataFrame) -> DataFrame:
    """One attachment a document: PDF before EPUB, then the smaller key; deleted and other kinds don't count."""
    rank = F.when(F.col("content_type") == "application/pdf", 0).when(F.col("content_type") == "application/epub+zip", 1)
    live = attachments.withColumn("_kind", rank).filter("NOT deleted AND _kind IS NOT NULL")
    return latest(live, ["document_id"], [F.col("_kind"), F.col("key")]).drop("_kind")


def effective_selection(documents: DataFrame, members: DataFrame, collection_modes: DataFrame, document_modes: DataFrame) -> DataFrame:
    """``documents`` with ``excluded``. If any collection is included, only members of included ones are in; else all but
    members of excluded ones. An excluded document is out in any case; including one adds nothing.

    members: collection_key, document_id; collection_modes: collection_key, mode; document_modes: document_id, mode.
    """
    modes = members.join(collection_modes, "collection_key").groupBy("document_id").agg(F.max(F.col("mode") == "included").alias("inc"), F.max(F.col("mode") == "excluded").alias("exc"))
    some = collection_modes.agg(F.coalesce(F.max(F.col("mode") == "included"), F.lit(False)).alias("some"))
    out = document_modes.filter("mode = 'excluded'").select("document_id", F.lit(True).alias("out")).distinct()
    joined = documents.join(modes, "document_id", "left").join(out, "document_id", "left").crossJoin(F.broadcast(some))  # one row
    base = F.when(F.col("some"), F.coalesce("inc", F.lit(False))).otherwise(~F.coalesce("exc", F.lit(False)))
    return joined.withColumn("excluded", ~base | F.coalesce("out", F.lit(False))).drop("inc", "exc", "out", "some")


def document_states(documents: DataFrame, jobs: DataFrame, document_modes: DataFrame) -> DataFrame:
    """``documents`` with job_status (of the newest job) and sync_state: held, synced, processing or pending."""
    newest = latest(jobs, ["document_id"], [F.desc("updated_at"), F.desc("job_id")]).select("document_id", F.col("status").alias("job_status"))
    joined = documents.join(newest, "document_id", "left").join(document_modes.select("document_id", "mode"), "document_id", "left")
    s = F.col("job_status")
    state = F.when(F.col("mode") == "excluded", "held").when(s == "completed", "synced").when(s.isin("claimed", "running", "processing"), "processing").when(s == "pending", "pending").otherwise("held")
    return joined.withColumn("sync_state", state).drop("mode")


def new_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (attachment_id, content_hash, force) that need a job: forced, or without one for that content."""
    known = jobs.select("attachment_id", "content_hash").distinct()
    fresh = wanted.filter("NOT force").dropDuplicates(["attachment_id", "content_hash"]).join(known, ["attachment_id", "content_hash"], "left_anti")
    return fresh.unionByName(wanted.filter("force").select(*fresh.columns))


def retire_and_revive(snapshots: DataFrame, attachments: DataFrame) -> DataFrame:
    """``snapshots`` (id, attachment_id, active, created_at): none active for deleted attachments; a live attachment without
    an active one gets its newest back. At most one is active for each."""
    live = attachments.select("attachment_id", F.col("deleted").alias("_gone"))
    joined = snapshots.join(live, "attachment_id", "left")
    per = W.partitionBy("attachment_id")
    newest = F.row_number().over(per.orderBy(F.desc("active"), F.desc("created_at"), F.desc("id"))) == 1
    return joined.withColumn("active", ~F.coalesce("_gone", F.lit(True)) & newest).select(*snapshots.columns)


#: Checks of a processor's result in the order in which the first failure is reported.
CHECKS = ("SOURCE_IDENTITY_MISMATCH", "SOURCE_HASH_MISMATCH", "SOURCE_NOT_VERIFIED", "CHUNK_INDEX_DUPLICATE", "CHUNK_INDEX_GAP", "REF_DUPLICATE", "REF_UNRESOLVED", "DENSE_DIMENSIONS", "DENSE_NOT_FINITE", "SPARSE_WEIGHT", "LOCATOR_MISSING", "EVIDENCE_MISSING", "STATS_MISMATCH")


def index_violations(chunks: DataFrame, owner: str, index: str) -> DataFrame:
    """(owner, code): indexes must be 0, 1, 2... once each."""
    facts = chunks.groupBy(owner).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    codes = F.array_compact(F.array(F.when(F.col("d") < F.col("n"), "CHUNK_INDEX_DUPLICATE"), F.when((F.col("lo") != 0) | (F.col("hi") != F.col("d") - 1), "CHUNK_INDEX_GAP")))
    return facts.select(owner, F.explode(codes).alias("code"))


def vector_violations(vectors: DataFrame, owner: str, vector: str, dimensions: int) -> DataFrame:
    """(owner, code): vectors must have the declared dimensions and finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    codes = F.array_compact(F.array(F.when(F.coalesce(F.size(vector), F.lit(-1)) != dimensions, "DENSE_DIMENSIONS"), F.when(bad, "DENSE_NOT_FINITE")))
    return vectors.select(owner, F.explode(codes).alias("code"))


def unresolved_refs(refs: DataFrame, known: DataFrame, owner: str, ref: str) -> DataFrame:
    return refs.join(known.select(owner, ref).distinct(), [owner, ref], "left_anti").select(owner, F.lit("REF_UNRESOLVED").alias("code"))


def violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def first_violation(found: DataFrame, owner: str) -> DataFrame:
    """(owner, code): the first by the order of CHECKS."""
    place = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("code"))
    return found.groupBy(owner).agg(F.min_by("code", place).alias("code"))


def artifact_violations(declared: DataFrame, verified: DataFrame) -> DataFrame:
    """(ref, code) over ref, sha256, size, media_type on both sides."""
    a, b = declared.alias("a"), verified.alias("b")
    both = a.join(b, F.col("a.ref") == F.col("b.ref"), "full_outer")
    differ = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    code = F.when(F.col("a.ref").isNull(), "ARTIFACT_REF_MISMATCH").when(F.col("b.ref").isNull(), "ARTIFACT_MISSING_RECORD").when(differ("sha256"), "ARTIFACT_DIGEST_MISMATCH").when(differ("size"), "ARTIFACT_SIZE_MISMATCH").when(differ("media_type"), "ARTIFACT_MEDIA_TYPE_MISMATCH")
    return both.select(F.coalesce("a.ref", "b.ref").alias("ref"), code.alias("code")).filter("code IS NOT NULL")


def changed_only(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``fresh`` that differ from the stored ones in a column; nulls equal nulls."""
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return fresh.join(old, key).filter(differs).select(*fresh.columns)


def resolved_view(members: DataFrame, collection_modes: DataFrame) -> DataFrame:
    """(collection_key, mode, document_ids in order, documents): what each selected collection holds."""
    joined = collection_modes.join(members.distinct(), "collection_key", "left")
    return joined.groupBy("collection_key", "mode").agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"), F.count("document_id").alias("documents"))


def active_once(snapshots: DataFrame) -> DataFrame:
    """Attachments that break the rule of at most one active snapshot."""
    return snapshots.filter("active").groupBy("attachment_id").agg(F.count("*").alias("n")).filter("n > 1")


def source_view(documents: DataFrame, lists: tuple[str, ...] = ("authors", "tags")) -> DataFrame:
    """``documents`` as callers see them: lists that are null are empty."""
    return documents.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def any_dimension(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: ``dim`` of a vector that isn't null (the largest, so that runs agree), or null."""
    return vectors.agg(F.max(F.when(F.col(vector).isNotNull(), F.size(vector))).alias("dim"))
