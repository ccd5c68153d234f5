"""Job and repair state: folds over event logs and decisions over snapshots.

Spark has no row locks, so claiming is not done here; a fold gives the state that the log of claims, renewals and results
leads to. A job's log is bounded by its attempts, so one job's events fit in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
TERMINAL = ("completed", "failed", "cancelled")
#: Fixed values of repair.
MAX_REPAIRS, LEAST_SCORE = 2, 0.95


def fold(events: DataFrame, job: str, order: list[str], event: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(job, status, attempt, ignored) after all events: enqueue, claim, renew, complete, fail, cancel.

    An event that doesn't fit the state is ignored and counted, as a fenced write is.
    """
    log = events.groupBy(job).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("e")))).alias("log"))
    state = lambda status, attempt, ignored: F.struct(status.alias("status"), attempt.cast("int").alias("attempt"), ignored.cast("int").alias("ignored"))

    def step(s: Column, x: Column) -> Column:
        e, status, n, ignored = x["e"], s["status"], s["attempt"], s["ignored"]
        running = status.isin("claimed", "processing")
        return (
            F.when((e == "enqueue") & status.isin(*TERMINAL), state(F.lit("pending"), F.lit(0), ignored))
            .when((e == "claim") & (status == "pending") & (n < max_attempts), state(F.lit("claimed"), n + 1, ignored))
            .when((e == "renew") & running, state(F.lit("processing"), n, ignored))
            .when((e == "complete") & running, state(F.lit("completed"), n, ignored))
            .when((e == "fail") & running, state(F.when(n < max_attempts, "pending").otherwise("failed"), n, ignored))
            .when((e == "cancel") & ~status.isin(*TERMINAL), state(F.lit("cancelled"), n, ignored))
            .otherwise(state(status, n, ignored + 1))
        )

    done = log.withColumn("s", F.aggregate("log", state(F.lit("pending"), F.lit(0), F.lit(0)), step))
    return done.select(job, "s.status", "s.attempt", "s.ignored")


def terminalized(status: Column, cancel: Column, expired: Column, attempt: Column, most: Column) -> Column:
    """Struct (status, error_code) of stale jobs: cancelled, LEASE_EXHAUSTED, RETRY_EXHAUSTED; others as they are."""
    running = status.isin("claimed", "processing")
    out = lambda s, code: F.struct(s.alias("status"), F.lit(code).cast("string").alias("error_code"))
    return (
        F.when((status == "pending") & cancel, out(F.lit("cancelled"), None))
        .when(running & cancel & expired, out(F.lit("cancelled"), None))
        .when(running & expired & (attempt >= most), out(F.lit("failed"), "LEASE_EXHAUSTED"))
        .when((status == "pending") & (attempt >= most), out(F.lit("failed"), "RETRY_EXHAUSTED"))
        .otherwise(out(status, None))
    )


def recovered(status: Column, cancel: Column, expired: Column, attempt: Column, most: Column) -> Column:
    """Status of a job after recovery of expired leases."""
    lost = status.isin("claimed", "processing") & expired
    return F.when(lost & cancel, "cancelled").when(lost & (attempt >= most), "failed").when(lost, "pending").otherwise(status)


def obsolescence(j: Column, d: Column, a: Column, item: Column) -> Column:
    """Why a job is obsolete, or null. j: source_id, document_id, attachment_id, content_hash, force; d, a, item: rows or null."""
    return (
        F.when(F.coalesce(j["source_id"], F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(j["document_id"], F.lit("")).eqNullSafe(F.lit("")) | d.isNull(), "PARENT_REMOVED")
        .when(d["deleted"], "ATTACHMENT_REMOVED")
        .when(j["attachment_id"].isNull(), "PARENT_REMOVED")
        .when(a.isNull() | a["deleted"], "ATTACHMENT_REMOVED")
        .when(~a["preferred"], "ATTACHMENT_NOT_PREFERRED")
        .when((d["source_id"] != j["source_id"]) | (a["document_id"] != j["document_id"]) | ~a["parent_key"].eqNullSafe(d["key"]), "PARENT_REMOVED")
        .when(F.coalesce(a["content_hash"], F.lit("")) == "", "CONTENT_HASH_MISSING")
        .when(~j["force"] & ~a["content_hash"].eqNullSafe(j["content_hash"]), "CONTENT_HASH_CHANGED")
        .when(item.isNull(), "CANONICAL_METADATA_MISSING")
    )


def claim_order(jobs: DataFrame, now: Column) -> DataFrame:
    """Claimable jobs in queue order: expired leases first, then lease end, time of entry, id."""
    expired = F.coalesce(F.col("lease_until") <= now, F.lit(False))
    able = (F.col("status") == "pending") & (F.coalesce(F.col("next_attempt_at") <= now, F.lit(True))) | (F.col("status").isin("claimed", "processing") & expired)
    return jobs.filter(able & (F.col("attempt") < F.col("max_attempts"))).orderBy(F.desc(expired), F.col("lease_until").asc_nulls_last(), "enqueued_at", "job_id")


def verdict_status(verdict: Column, score: Column, contradictions: Column) -> Column:
    """State of a repair case after a verdict: only a sure one without contradictions goes on by itself."""
    sure = (verdict == "auto_apply") & (score >= LEAST_SCORE) & (contradictions == 0)
    return F.when(sure, "in_repair").when(verdict == "failed", "failed").otherwise("blocked")


def repair_claim(status: Column, attempts: Column) -> Column:
    """State after an attempt to claim: the loop guard blocks after MAX_REPAIRS, else queued cases start."""
    return F.when((attempts >= MAX_REPAIRS) & status.isin("queued", "rejected"), "blocked").when((status == "queued") & (attempts < MAX_REPAIRS), "in_repair").otherwise(status)


def job_counts(jobs: DataFrame, source: str = "source_id") -> DataFrame:
    return jobs.groupBy(source).agg(F.count("*").alias("jobs"))


def newest_jobs(jobs: DataFrame, n: int, source: str = "source_id") -> DataFrame:
    """The ``n`` jobs of each source that were made last, newest first by ``place``; ties go to the larger job_id."""
    order = W.partitionBy(source).orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def list_jobs(jobs: DataFrame, n: int = 50, attachment_id: object = None) -> DataFrame:
    """The ``n`` jobs of all sources that were entered last (50 if not positive), newest first; all of one attachment if it is given."""
    if attachment_id is not None:
        return jobs.filter(F.col("attachment_id") == attachment_id).orderBy(F.desc("enqueued_at"), F.desc("job_id"))
    return jobs.orderBy(F.desc("enqueued_at"), F.desc("job_id")).limit(n if n > 0 else 50)


def clear_acks(jobs: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """``jobs`` without the mark of those completed ones that are in ``acknowledged`` (job_id); others keep theirs."""
    told = acknowledged.select("job_id").distinct().withColumn("told", F.lit(True))
    marked = jobs.join(told, "job_id", "left")
    clear = F.coalesce("told", F.lit(False)) & (F.col("status") == "completed")
    return marked.withColumn("ack_pending_at", F.when(~clear, F.col("ack_pending_at"))).select(*jobs.columns)


def ack_failed(status: Column, pending_at: Column, now: Column) -> Column:
    """When a completed job's acknowledgement first failed; jobs in other states keep their mark."""
    return F.when(status == "completed", F.coalesce(pending_at, now)).otherwise(pending_at)


def pending_acks(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """(job_id, snapshot_id): completed jobs that wait for an acknowledgement, oldest mark first, at most ``limit`` (50 if not positive)."""
    waiting = jobs.filter("status = 'completed' AND ack_pending_at IS NOT NULL").orderBy("ack_pending_at", "job_id").limit(limit if limit > 0 else 50)
    return waiting.select("job_id", F.coalesce("snapshot_id", F.lit("")).alias("snapshot_id"))
