"""Passages and their surroundings: neighbours, the page in effect at an offset, liveness, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbors(chunks: DataFrame, owner: str, index: str, value: str, reach: int = 1) -> DataFrame:
    """``chunks`` with ``before`` and ``after``: values of the chunks at index -1 and +1 of the same owner, if they exist."""
    w = W.partitionBy(owner).orderBy(index).rangeBetween
    return chunks.withColumn("before", F.first(value).over(w(-reach, -reach))).withColumn("after", F.first(value).over(w(reach, reach)))


def page_at(offset: Column, bounds: Column, default: Column) -> Column:
    """Label of the last boundary (struct offset, label) at or before ``offset``; before all of them the default."""
    past = F.filter(bounds, lambda b: b["offset"] <= offset)
    return F.when(F.size(past) > 0, F.element_at(F.sort_array(past), -1)["label"]).otherwise(default)


def paragraph_pages(c: Column) -> Column:
    """[[offset, label], ...] as structs; offsets may be numbers or texts, entries that aren't pairs are left out."""
    pairs = F.from_json(c, "array<array<string>>")
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & p[0].rlike("^[0-9]+$"))
    return F.transform(good, lambda p: F.struct(p[0].cast("int").alias("offset"), p[1].alias("label")))


def liveness(ids: DataFrame, chunks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``ids`` (chunk_id) with ``state``: active, superseded or unknown."""
    known = chunks.join(snapshots, "snapshot_id").groupBy("chunk_id").agg(F.max("active").alias("active"))
    return ids.join(known, "chunk_id", "left").withColumn("state", F.when(F.col("active").isNull(), "unknown").when(F.col("active"), "active").otherwise("superseded")).drop("active")


def materialize(chunks: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Chunks with their vectors for the index; missing vectors stay null."""
    return chunks.join(dense, "chunk_id", "left").join(sparse, "chunk_id", "left")


def union_evidence(mention_chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct chunk ids that are mentioned in or are evidence; ``evidence`` holds arrays."""
    return mention_chunks.select("chunk_id").union(evidence.select(F.explode("evidence"))).distinct()


def counts_with_first(rows: DataFrame, group: str, order: list[str], value: str, k: int) -> DataFrame:
    """(group, n, first): the count, and the first k values in order; only k rows of a group are gathered."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    top = rows.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= k)
    first = top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("v")))), lambda x: x["v"]).alias("first"))
    return counts.join(first, group)
