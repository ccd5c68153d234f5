"""Document fingerprints by winnowing: rolling k-gram hashes, the least of each window, and where it stands.

The grams are K consecutive code points. Of each WINDOW consecutive grams the least hash is kept, the rightmost of equal ones,
with its position. Two texts that share a passage of at least K + WINDOW - 1 = 59 code points therefore keep a common gram of it,
at the same place in the passage (the match guarantee); no passage shorter than K gives a common gram but by chance. A text of
fewer than K code points has one gram, all of it; one of fewer than WINDOW grams has one window. Likeness is the share of common
hashes among all hashes of two fingerprints; two empty fingerprints are alike (1), an empty and another aren't (0).

``annotate`` adds hashes and positions to any table, ``postings`` gives a row a kept gram for an inverted index, and ``edited`` compares
each document with its successor and with its own text whose end is replaced by the successor's beginning. The successor
comes without a window over all rows and with one shuffle of texts: rows are dealt to buckets of consecutive ids, cut at
quantiles (an id that fills several is split by its texts' hashes), the first row of each bucket is dealt to the bucket before
as well (the first of all to the last), and a task meets its rows in order, one at a time.

Null text is empty: no fingerprint, the empty string. Equal texts have equal fingerprints. Very long texts are hashed whole, in
blocks. Rows of equal ids are ordered by a hash of the text, then the text; a null id comes before all others. One row is its own successor; an
empty table gives no rows. ``annotate`` keeps all other columns, and replaces columns of the names it adds.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, LongType, StructType

from lectern.llm.common import named
from lectern.llm.wordhash import mix

K, WINDOW = 12, 48
#: Grams are hashed to 48 bits; a block has so many grams that the other 16 bits of a number hold a place in it.
PLACES = 16
BLOCK = (1 << PLACES) - WINDOW
_BASE = 0x9E3779B97F4A7C15


def grams(codes: np.ndarray) -> np.ndarray:
    """48-bit hashes of all K-grams of the code points, each made from two halves' polynomial hashes."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(K, n)
    power = lambda e: np.uint64(pow(_BASE, e, 1 << 64))
    doubled, size = codes.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if width & size:  # the next ``size`` code points of a gram begin ``done`` after its start
            out = doubled[done:] if out is None else out[: len(doubled) - done] * power(size) + doubled[done : done + len(out)]
            done += size
        if done == width:
            return mix(out[: n - width + 1]) >> np.uint64(PLACES)
        doubled, size = doubled[:-size] * power(size) + doubled[size:], 2 * size


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive numbers."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def winnow(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that are kept of a text, by position."""
    hashes = grams(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    width, kept = min(WINDOW, len(hashes)), []
    for begin in range(0, len(hashes) - width + 1, BLOCK):
        block = hashes[begin : begin + BLOCK + width - 1]
        place = np.arange(len(block), dtype=np.uint64)
        last = np.uint64((1 << PLACES) - 1)
        low = _least(block << np.uint64(PLACES) | last - place, width)  # of equal hashes the rightmost is least
        kept.append(begin + (last - (low & last)).astype(np.int64))
    at = np.concatenate(kept)
    at = at[np.append(True, at[1:] != at[:-1])]
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common hashes among all hashes of two fingerprints."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: base 64 of (6 bytes of hash, 4 bytes of position), little-endian, a kept gram."""
    out = np.zeros((len(hashes), 10), np.uint8)
    out[:, :6] = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    out[:, 6:] = positions.astype("<u4").view(np.uint8).reshape(-1, 4)
    return b64encode(out.tobytes()).decode()


def annotate(df: DataFrame, text: str = "text", hashes: str = "gram_hashes", positions: str = "gram_positions") -> DataFrame:
    """``df`` with the kept hashes and their positions, two arrays; no row moves."""
    rest = df.drop(hashes, positions)
    packed = df.select(F.struct(*named(rest)).alias("row"), F.col(text).cast("string").alias("body"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(x.as_py() or "") for x in batch["body"]]
            columns = [pa.array([y[k].astype(np.int64) for y in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["row"], *columns], ["row", "hashes", "positions"])

    out = packed.mapInArrow(tasks, StructType().add("row", rest.schema).add("hashes", ArrayType(LongType())).add("positions", ArrayType(LongType())))
    return out.select("row.*", F.col("hashes").alias(hashes), F.col("positions").alias(positions))


def postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, position), a row a kept gram: what an inverted index of passages holds."""
    found = annotate(df.select(F.col(key), F.col(text).alias("body_text")), "body_text")
    return found.select(key, F.inline(F.arrays_zip("gram_hashes", "gram_positions"))).toDF(key, "hash", "position")


#: Buckets a shuffle partition, and at most in all: their bounds, as many numbers, are part of the plan, and their first rows are broadcast.
BUCKETS_EACH, MOST_BUCKETS = 2, 1 << 16


def _place(bounds: list[int], key: Column, spread: Column) -> Column:
    """The bucket of a row: how many bounds its key reaches; a key that stands at several bounds is split by ``spread``."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def reached(passes: Callable[[Column], Column]) -> Column:  # bisection
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & F.coalesce(passes(F.get(held, at + s - 1)), F.lit(False)), at + s).otherwise(at))

    below, upto = reached(lambda b: b < key), reached(lambda b: b <= key)
    share = (F.shiftright(spread, 33) + (1 << 30)) / float(1 << 31)
    return F.when(upto - below < 2, upto).otherwise(below + F.floor(share * (upto - below + 1)).cast("int"))


def with_successor_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, body, extra): rows in buckets of consecutive ids; ``extra`` marks the row that follows a bucket's last one.

    Partitions hold whole buckets, sorted by bucket, extra, id, hash and text.
    """
    spark = df.sparkSession
    count = min(MOST_BUCKETS, BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    ordered = F.coalesce("id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("body").alias("h")
    share = F.array(*[F.lit(i / count) for i in range(1, count)])
    bounds = rows.agg(F.percentile_approx(F.coalesce("id", F.lit(-(1 << 63))), share, F.lit(10 * count))).first()[0]
    placed = rows.select("*", *ordered).withColumn("bucket", _place(sorted(bounds or []), F.col("k"), F.col("h")))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("first"))  # at most ``count`` rows
    every = W.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    lead = F.broadcast(firsts.select(F.col("first.k").alias("first_k"), F.col("first.h").alias("first_h"), before.alias("into")))
    met = placed.join(lead, (F.col("k") == F.col("first_k")) & (F.col("h") == F.col("first_h")), "left")
    own, extra = F.struct(F.col("bucket"), F.lit(False).alias("extra")), F.struct(F.col("into").alias("bucket"), F.lit(True).alias("extra"))
    dealt = met.select("id", "body", "k", "h", F.inline(F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    return dealt.repartition(count, "bucket").sortWithinPartitions("bucket", "extra", "k", "h", "body").select("id", "body", "extra")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []  # the row before: id, text, hashes, positions
    for batch in batches:
        for id_, body, extra in zip(batch["id"], batch["body"], batch["extra"], strict=True):
            text, extra = body.as_py(), extra.as_py()
            if held is None and extra:
                continue  # one extra row was enough
            kept = winnow(text)
            if held is not None:
                out.append(_row(held, text, kept[0]))
            held = None if extra else (id_.as_py(), text, *kept)
            if len(out) == 512:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out = []
    yield pa.RecordBatch.from_pylist(out, _SCHEMA)


_SCHEMA = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _row(held: tuple, following: str, next_hashes: np.ndarray) -> dict:
    id_, text, hashes, positions = held
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + following[:quarter]
    found = winnow(edited)
    return {
        "id": id_, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": written(hashes, positions), "edited_fingerprint": written(*found),
        "near_edited": likeness(hashes, found[0]), "near_next": likeness(hashes, next_hashes),
    }


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter (rounded down) replaced by as many first code points of the successor, or all it has.
    """
    found = with_successor_order(df, key, text).mapInArrow(_compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", key)
