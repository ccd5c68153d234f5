"""K-d tree sharding with DataFrame functions only: nodes split at distributed weighted medians along their widest dimension.

A node that must hold s shards splits where its left part weighs floor(s/2)/s of it, along the dimension whose range in the
node is widest in relation to the whole table's. Points are ordered by (value on a grid of 2**16, hash of the ``near`` columns,
hash of the tie columns), so ties of any size, a third of all rows too, split evenly. The place is found by four rounds of 8192
bins: weights are summed by (node, bin) before they shuffle. Sizes then differ from the mean by about one row.

What the driver and a broadcast hold is one row a node of the level, so at most ``MOST_SHARDS`` rows of a few numbers. Each level
is cut into the shared folder.

Equal texts have equal size and equal ``near`` hash, so those that also share source and language lie side by side: such a group
is in one shard but where a median falls inside it, which the law of bytes then demands. Copies with other metadata are other
points.

Null text weighs nothing, null dimensions count as 0; rows that repeat an id and a text stay together. Very long texts are one row
and can make a shard larger by themselves. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import cut, free_name, named, rank_in_groups, small_table

GRID_BITS, NEAR_BITS, TIE_BITS, BIN_BITS = 16, 18, 18, 13
MOST_SHARDS = 100_000


def shards_for(df: DataFrame, weight: str, target_bytes: int) -> int:
    """How many leaves of about ``target_bytes`` the table needs."""
    return max(1, -(-int(df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]) // target_bytes))


def assign(df: DataFrame, dimensions: list[str], weight: str, tie: list[str], shards: int, name: str = "shard", near: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``, 0 to shards - 1; the sum of ``weight`` is nearly equal in all. ``dimensions`` are numeric columns."""
    if shards > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards")
    spark, df = df.sparkSession, df.drop(name)
    own, (order, node, weighed) = named(df), (free_name(df, n) for n in ("order", "node", "weighed"))
    values = [F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dimensions]
    low = F.shiftrightunsigned(F.xxhash64(*tie), 64 - TIE_BITS)
    if near:
        low = low + F.shiftleft(F.shiftrightunsigned(F.xxhash64(*near), 64 - NEAR_BITS), TIE_BITS)
    state = df.withColumn(name, F.pmod(F.xxhash64(*tie), F.lit(1)).cast("int"))  # 0; a literal would make the joins nested loops
    spans = df.agg(*[(F.max(v) - F.min(v)).alias(f"s{i}") for i, v in enumerate(values)]).first()
    live = {0: shards}  # a node's name is its first shard
    while live := {n: s for n, s in live.items() if s > 1}:
        nodes = small_table(spark, [(n,) for n in live], f"{node} int")
        inside = state.join(F.broadcast(nodes), F.col(name) == F.col(node)).drop(node)
        facts = [f(v).alias(f"{k}{i}") for i, v in enumerate(values) for k, f in (("lo", F.min), ("hi", F.max))]
        plan = {}  # node: (dimension, its least value, its range, goal of the left part's weight)
        for r in inside.groupBy(F.col(name).alias(node)).agg(F.sum(weight).alias("w"), *facts).collect():
            width = [(r[f"hi{i}"] - r[f"lo{i}"]) / (spans[i] or 1.0) for i in range(len(values))]
            i = max(range(len(width)), key=width.__getitem__)
            plan[r[node]] = (i, r[f"lo{i}"], (r[f"hi{i}"] - r[f"lo{i}"]) or 1.0, r["w"] * (live[r[node]] // 2) / live[r[node]])
        if not plan:
            break

        def placed(rows: DataFrame, plan=plan) -> DataFrame:
            told = small_table(spark, [(n, *p[:3]) for n, p in plan.items()], f"{node} int, {node}_d int, {node}_lo double, {node}_span double")
            value = F.element_at(F.array(*values), F.col(f"{node}_d") + 1)
            grid = F.floor((value - F.col(f"{node}_lo")) / F.col(f"{node}_span") * F.lit(float((1 << GRID_BITS) - 1))).cast("long")
            at = F.shiftleft(grid, NEAR_BITS + TIE_BITS) + low
            return rows.join(F.broadcast(told), F.col(name) == F.col(node), "left").withColumn(order, at)

        keyed = placed(state).filter(F.col(node).isNotNull()).select(node, F.col(weight).alias(weighed), order)
        start, before, last = dict.fromkeys(plan, 0), dict.fromkeys(plan, 0), {}
        for shift in range(GRID_BITS + NEAR_BITS + TIE_BITS - BIN_BITS, -BIN_BITS, -BIN_BITS):
            shift = max(0, shift)
            told = small_table(spark, [(n, start[n], float(plan[n][3] - before[n])) for n in plan], "n int, start long, goal double")
            binned = keyed.join(F.broadcast(told), F.col(node) == F.col("n")).withColumn("bin", F.shiftright(F.col(order) - F.col("start"), shift)).filter(f"bin >= 0 AND bin < {1 << BIN_BITS}")
            summed = binned.groupBy(F.col("n"), F.col("bin"), F.col("goal")).agg(F.sum(weighed).alias("w"))
            sums = summed.withColumn("upto", F.sum("w").over(W.partitionBy("n").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
            for r in sums.filter("upto >= goal").groupBy("n").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("x")).collect():
                n, x = r["n"], r["x"]
                start[n] += x["bin"] << shift
                before[n] += x["upto"] - x["w"]
                last[n] = x["w"]
        ends = []
        for n, p in plan.items():  # the row on the line goes where it leaves less over
            ends.append((n, start[n] + (before[n] + last[n] - p[3] <= p[3] - before[n]), n + live[n] // 2))
        told = small_table(spark, ends, f"{node}_n int, {node}_end long, {node}_right int")
        split = placed(state).join(F.broadcast(told), F.col(node) == F.col(f"{node}_n"), "left")
        side = F.when(F.col(order) < F.col(f"{node}_end"), F.col(name)).otherwise(F.coalesce(f"{node}_right", name))
        state = cut(split.select(*own, side.cast("int").alias(name)))
        live = {k: v for n, s in live.items() if n in plan for k, v in ((n, s // 2), (n + s // 2, s - s // 2))}
    return state


def shard_documents(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard); dimensions: bytes of the text, its source and its language."""
    body = F.coalesce(F.col(text), F.lit(""))
    known = {c.lower() for c in docs.columns}
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1000)) if c in known else F.lit(0)
    points = cut(docs.select(F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"), F.log2(F.octet_length(body) + 8).alias("d_bytes"), code("source").alias("d_source"), code("lang").alias("d_lang")))
    parts = max(64, points.count() // (shards * 200_000))
    placed = assign(points, ["d_bytes", "d_source", "d_lang"], "size", [key, "text_hash"], shards, near=["text_hash"])
    rows = rank_in_groups(placed, "shard", [key, "text_crc32", "size"], "slot", parts)
    return rows.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_to_target(docs: DataFrame, target_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``shard_documents`` in as many shards as make leaves of about ``target_bytes``."""
    sizes = docs.select((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).alias("size"))
    return shard_documents(docs, shards_for(sizes, "size", target_bytes), text, key)
