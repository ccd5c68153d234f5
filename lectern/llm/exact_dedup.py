"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 is a counting Bloom filter with one slot a row in a space so wide (2**44) that strangers seldom meet. Its counters are
kept as the slots in use with their counts, summed before the shuffle: with many tasks a task's bitmap over that space is almost
empty, so its slots are shorter than its bitmap. Slots counted twice or more set bits in a second filter, a bitmap of about 16
bits a repeated slot, that is broadcast up to a fixed bound. Pass 2 probes each row: a row whose bits aren't all set has no copy
and passes straight through with all its columns; only the others shuffle, by SHA-256, and are decided exactly. A full bitmap
costs speed, never correctness: then all rows take the second way.

The text is read once where only the decisions are wanted (``decide``): ids, slots and digests are cut first. ``annotate`` reads
it again for each of the two ways.

Null text counts as empty. Of equal texts the row with the largest id stays; a null id is smaller than any other; rows
that repeat the id of the one that stays are the same document and are all kept. Very long texts are hashed whole. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import MOST_BITS, cut, free_name, membership_filter, named, with_group_facts, with_probe

#: Pass 1 counts in so many slots.
SLOTS = 1 << 44


def slot_of(body: Column) -> Column:
    return F.pmod(F.xxhash64(body), F.lit(SLOTS))


def repeated_slots(slots: DataFrame) -> tuple[DataFrame, int]:
    """The slots (column ``slot``) that occur more than once, and how many rows there are; one pass over ``slots``."""
    counted = slots.groupBy("slot").agg(F.count("*").alias("n"))
    total = F.sum("n").alias("n")
    both = cut(counted.filter("n > 1").select("slot", "n").unionByName(counted.filter("n = 1").agg(F.lit(None).cast("long").alias("slot"), total)))
    return both.filter("slot IS NOT NULL").select("slot"), int(both.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _judged(suspects: DataFrame, key: str, total: int) -> DataFrame:
    """``suspects`` (key, text_sha256, more) with keep_id and group_size."""
    groups = cut(suspects.groupBy("text_sha256").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size")))
    return with_group_facts(suspects, groups, "text_sha256", "group_size", total, [key])


def decide(df: DataFrame, text: str = "text", key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row; the text is read once."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    thin = cut(df.select(F.col(key), slot_of(body).alias("slot"), F.sha2(body, 256).alias("text_sha256")))
    return _decided(thin, key, most_bits)


def _decided(thin: DataFrame, key: str, most_bits: int) -> DataFrame:
    repeated, total = repeated_slots(thin.select("slot"))
    flag = free_name(thin, "suspect")
    marked = with_probe(thin, F.col("slot"), membership_filter(repeated, most_bits), flag).drop("slot")
    alone = marked.filter(~F.col(flag)).drop(flag).select("*", F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    decided = _judged(marked.filter(F.col(flag)).drop(flag), key, total)
    return alone.unionByName(decided).select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def annotate(df: DataFrame, text: str = "text", key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """``df`` with keep_id, group_size, kept and text_sha256 (columns of these names are replaced)."""
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    flag, sha = free_name(df, "suspect"), "text_sha256"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    repeated, total = repeated_slots(df.select(slot_of(body).alias("slot")))
    rows = with_probe(df, slot_of(body), membership_filter(repeated, most_bits), flag).withColumn(sha, F.sha2(body, 256))
    alone = rows.filter(~F.col(flag)).drop(flag).select("*", F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    decided = _judged(rows.filter(F.col(flag)).drop(flag), key, total)
    return alone.unionByName(decided).withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id"))).select(*named(df), "keep_id", "group_size", "kept", sha)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
