"""Best-fit-decreasing packing planned on a histogram of lengths.

The plan works on counts, never on documents: lengths from long to short, each into the fullest open sequences that still
hold it, whole runs of sequences at a time. It has a few rows a length, so it is as small at 100 TB as at 1 MB. Documents
then take the planned places by joining on their rank within their length.

Null text counts as empty (one end id). Very long texts are tokenised whole and cut into full pieces, of which the first may be shorter.
Equal lengths are ties that any order settles. Repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import cut, rank_in_groups, small_table

CAPACITY = 1024
PLAN = "length long, low long, high long, base long, per long, place long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, base, per, place): ranks low..high-1 of that length go to sequence base + (rank - low) // per,
    at place + length * ((rank - low) % per). Lengths must be in 1..capacity."""
    out: list[tuple[int, int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free ids: runs (first sequence, how many)
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            free = next((r for r in range(length, capacity) if room[r]), capacity)
            per = free // length
            if free < capacity:
                base, runs = room[free].pop()
            else:  # open as many new ones as this length needs
                base, runs = opened, -(-left // per)
                opened += runs
            full = min(runs, left // per)
            parts = [(full, per)] if full else []
            if full < runs and left - full * per > 0 and (full + 1) * per > left:
                parts.append((1, left - full * per))
            for count, each in parts:
                out.append((length, rank, rank + count * each, base, each, capacity - free))
                room[free - each * length].append((base, count))
                rank, left, base, runs = rank + count * each, left - count * each, base + count, runs - count
            if runs:
                room[free].append((base, runs))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = cut(tokens.piece_table(docs, capacity, text, key, path=path))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    total = sum(histogram.values())
    planned = small_table(pieces.sparkSession, plan(histogram, capacity), PLAN)
    ranked = rank_in_groups(pieces, "length", [key, "piece", "start", "ids_crc32"], "rank", parts=max(16, min(4096, total // 100_000)))
    own = F.col("rank") - F.col("low")
    joined = ranked.join(F.broadcast(planned.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    sequence = F.col("base") + F.floor(own / F.col("per")).cast("long")
    offset = F.col("place") + F.col("length") * F.pmod(own, F.col("per"))
    return joined.select(key, "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.cast("long").alias("offset"))
