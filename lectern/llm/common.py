"""What the training-data operators share: the cluster's shared folder, lineage cuts, distributed ranks and skew-safe group facts."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A group with more than this share of all rows is hot; there are at most HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one only where that is unset (tests)."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lectern-')}")
    return sc.getCheckpointDir().rstrip("/")


_made: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path (not yet made) in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the folders that this application's operators have made so far, once their results are written; returns how many went.

    Results that are still to be read need them, so nothing is removed without this call.
    """
    gone = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return gone


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a lost executor loses none of it.

    Unlike a checkpoint, a table brings its real size: the optimizer multiplies the sizes that joins might have, which in loops
    of joins over checkpoints grows until planning takes minutes.
    """
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """``df`` computed once by checkpoint, which keeps its partitions: for tasks that read again what they wrote themselves."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of numbers from the driver as a table, made by Spark's own functions."""
    names = [c.split()[0] for c in columns.split(", ")]
    held = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    listed = F.from_json(F.lit(held), f"array<struct<{', '.join(c.replace(' ', ':') for c in columns.split(', '))}>>")
    return spark.range(1).select(F.inline(listed))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column's name of ``df`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def named(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever they are called."""
    return [F.col(f"`{c}`") for c in df.columns]


def filter_rows(df: DataFrame, columns: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``judge`` keeps, with all columns of ``df`` as they were, whatever they are called.

    ``judge`` sees the named columns and the whole row in one more, so names that it makes can't clash.
    """
    row = free_name(df.select(*columns), "row")
    packed = df.select(*columns, F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(row))
    return judge(packed).select(f"{row}.*")


def rank_in_groups(df: DataFrame, group: str, spread: list[str], rank: str, parts: int = 64) -> DataFrame:
    """``df`` with ``rank``, 0, 1, 2... without gaps in each ``group``, however large a group is.

    A group is dealt into ``parts`` by the hash of the ``spread`` columns; the parts' counts (groups x parts rows, summed
    before the shuffle) give each part its first rank, and only rows of one part meet for row_number.
    """
    part, own_group, own_part, first = (free_name(df, n) for n in ("part", "of_group", "of_part", "first"))
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(group, part).agg(F.count("*").alias(first))
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias(own_group), F.col(part).alias(own_part), F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    own = F.row_number().over(W.partitionBy(group, part).orderBy(*spread))
    ranked = dealt.withColumn(rank, own.cast("long"))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col(own_group)) & (F.col(part) == F.col(own_part)))
    return joined.withColumn(rank, F.col(rank) - 1 + F.col(first)).select(*df.columns, rank)


def with_group_facts(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: list[str], inner: bool = False) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row a ``key``), whatever share of the rows one key holds.

    Groups of more than 1/HOT_SHARE of ``total`` rows, at most HOT_SHARE of them by that bound, are broadcast. The other
    groups join by a shuffle, in which rows of hot groups and rows without a key are dealt by the hash of their ``spread``
    columns, so no task gets a group that is large. Rows without a group get nulls, or go if ``inner``.
    """
    facts = [c for c in groups.columns if c != key]
    most = max(1000, total // HOT_SHARE)
    hot_key, cold_key, own_key, salt, zero = (free_name(rows, n) for n in ("hot_key", "cold_key", "own_key", "salt", "zero"))
    hot_fact, cold_fact = ({c: f"{free_name(rows, n)}_{c}" for c in facts} for n in ("hot_fact", "cold_fact"))
    hot = groups.filter(F.col(size) > most).select(F.col(key).alias(hot_key), *[F.col(c).alias(hot_fact[c]) for c in facts])
    always_0 = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")  # a literal would drop out of the join's keys
    cold = groups.filter(F.col(size) <= most).select(F.col(key).alias(cold_key), always_0.alias(zero), *[F.col(c).alias(cold_fact[c]) for c in facts])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    apart = F.col(hot_key).isNotNull() | F.col(key).isNull()
    marked = marked.withColumn(own_key, F.when(~apart, F.col(key))).withColumn(salt, F.when(apart, F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("int") + 1).otherwise(0))
    joined = marked.join(cold, (F.col(own_key) == F.col(cold_key)) & (F.col(salt) == F.col(zero)), "left")
    if inner:
        joined = joined.filter(F.col(hot_key).isNotNull() | F.col(cold_key).isNotNull())
    return joined.select(*[c for n, c in zip(rows.columns, named(rows), strict=True) if n not in facts], *[F.coalesce(hot_fact[c], cold_fact[c]).alias(c) for c in facts])


#: A membership filter has about BITS_EACH bits a member, in buckets of 4 KB; MOST_BITS (256 MB) bound what is broadcast.
#: Up to 2**28 members it clears 95 % of strangers; with more it clears fewer, and those shuffle and are decided exactly.
BUCKET_BITS, BITS_EACH, MOST_BITS = 1 << 15, 16, 1 << 31
PROBES = 2


@dataclass
class Filter:
    """A Bloom filter as rows (bucket, bitmap); a member's bits all lie in its bucket."""

    bitmap: DataFrame
    buckets: int


def _places(slot: Column, buckets: int) -> tuple[Column, list[Column]]:
    bits = [F.pmod(F.xxhash64(slot, F.lit(k)), F.lit(BUCKET_BITS)).cast("int") for k in range(1, PROBES + 1)]
    return F.pmod(F.xxhash64(slot, F.lit(0)), F.lit(buckets)).cast("int"), bits


def membership_filter(slots: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """A filter of the column ``slot`` of a table that is cheap to read twice (a cut one); its size follows the members' count."""
    wanted = max(1, slots.count()) * BITS_EACH
    buckets = max(1, min(1 << (wanted - 1).bit_length(), most_bits) // BUCKET_BITS)
    bucket, bits = _places(F.col("slot"), buckets)
    each = slots.select(bucket.alias("bucket"), F.explode(F.array(*bits)).alias("b"))
    return Filter(cut(each.groupBy("bucket").agg(F.expr("bitmap_construct_agg(b)").alias("bitmap"))), buckets)


def with_probe(df: DataFrame, slot: Column, members: Filter, flag: str) -> DataFrame:
    """``df`` with ``flag``: false only if the slot is surely not in the filter, whose bounded bitmap is broadcast."""
    own, bucket, held = (free_name(df, n) for n in ("own_slot", "bucket", "bitmap"))
    place, bits = _places(F.col(own), members.buckets)
    known = F.broadcast(members.bitmap.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(held)))
    byte = lambda at: F.conv(F.hex(F.substring(F.col(held), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = [F.getbit(byte(at), F.pmod(at, F.lit(8))) == 1 for at in bits]
    rows = df.withColumn(own, slot)
    rows = rows.join(known, place == F.col(bucket), "left")
    return rows.withColumn(flag, F.coalesce(is_set[0] & is_set[1], F.lit(False))).select(*named(df), flag)


def without_ids(df: DataFrame, losers: DataFrame, keys: list[str], thin: DataFrame | None = None) -> DataFrame:
    """``df`` less the rows whose ``keys`` are in ``losers`` (a cut table of them); ``thin`` has the keys of all rows, if cheaper to read.

    A filter of the losers clears most rows that stay. Of the rest only the keys shuffle, to find those that were flagged for
    nothing; a second filter of these is all that makes whole rows shuffle: about the square of a filter's error of the losers.
    """
    flag, again = free_name(df, "suspect"), free_name(df, "again")
    slot = F.xxhash64(*[F.col(k) for k in keys])
    bitmap = membership_filter(losers.select(slot.alias("slot")))
    flagged = with_probe((df if thin is None else thin).select(*keys), slot, bitmap, flag).filter(F.col(flag)).select(*keys).distinct()
    for_nothing = cut(flagged.join(losers.select(*keys).distinct(), keys, "left_anti"))
    marked = with_probe(df, slot, bitmap, flag)
    clear = marked.filter(~F.col(flag)).drop(flag)
    if for_nothing.isEmpty():
        return clear
    second = with_probe(marked.filter(F.col(flag)).drop(flag), slot, membership_filter(for_nothing.select(slot.alias("slot"))), again)
    return clear.unionByName(second.filter(F.col(again)).join(losers.select(*keys).distinct(), keys, "left_anti").select(*named(df)))


def only_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` joined with ``wanted`` (cut, one row a ``key``) on ``key``; rows that a membership filter rules out don't shuffle."""
    flag = free_name(df, "suspect")
    bitmap = membership_filter(wanted.select(F.xxhash64(F.col(key)).alias("slot")))
    marked = with_probe(df, F.xxhash64(F.col(key)), bitmap, flag)
    return marked.filter(F.col(flag)).drop(flag).join(wanted, key)
