"""Near-duplicates: MinHash bands propose, sequential Bayesian tests prune, full shingle sets confirm.

1. Every text becomes its set of distinct k-word shingles (A-Z folded; words are runs of bytes other than space and
   U+0009..U+000D), a signature of ``HASHES`` minima and band keys. Texts with equal sets form one class, so copies cost
   one signature. Texts without words have an empty set and link with nothing; fewer words than k make one shingle.
2. Classes that share a band key are compared in batches of 32 signature places; a pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``MISS``. What stays joins clusters.
3. Within each cluster the full sets confirm links: 100 * intersection >= percent * union.
4. Components of the confirmed links are the groups; the smallest id names them.

Bands are as many and as narrow as makes the chance that a pair at the threshold shares fewer than two at most ``MISS``.

No group meets in one task: groups above ``BLOCK`` are dealt into blocks. Blocks are linked alone first; then only members
outside a group's largest component visit the other blocks, so a group of similar texts costs in proportion to its size and
no pair that could add a link is skipped. Pairs already connected aren't compared, and only links are emitted, not pairs.
A band group in which that would be more than ``CROWD`` visits a member (many texts that aren't similar share the band) is
crowded: its pairs meet in one of the other bands that they share. Where all of these are crowded too, they meet in the group of
those that share two crowded bands; there every visit is made.

The full sets are compared within clusters in the same way, without the rule for crowded groups: n texts that the signatures
can't tell from similar ones but whose sets are not make about n * n / BLOCK visits.

Rows with a null id get a null group and aren't kept; rows that share an id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import wordhash
from lectern.llm.common import cut, only_ids, with_group_facts, without_ids
from lectern.llm.components import components

HASHES = 224
BATCH = 32
MISS = 1e-6
BLOCK = 512
CROWD = 1
_rng = np.random.default_rng(411)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def banding(percent: int, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, places a band): the widest bands of which a pair at the threshold shares fewer than two with probability ``miss`` at most."""
    s = percent / 100
    few = lambda p, n: (1 - p) ** n + n * p * (1 - p) ** (n - 1)
    fitting = [r for r in range(1, hashes + 1) if few(s**r, hashes // r) <= miss]
    rows = max(fitting, default=1)
    return hashes // rows, rows


def least_matches(percent: int, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal places with which P(similarity >= threshold | places) is still ``miss``.

    With a uniform prior the posterior is a beta distribution; its upper tail at s after m of n is P(Binomial(n + 1, s) <= m).
    """
    s, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        tail = 0.0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * _A + _B).min(axis=0), out=least)
    return least


def sketch(docs: DataFrame, k: int, percent: int, text: str, key: str) -> DataFrame:
    """(key, n_shingles, digest of the set, places, bands) of every row."""
    bands, rows = banding(percent)
    weights = np.random.default_rng(97).integers(0, 1 << 63, (bands, rows + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([own.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sizes, digests, places, keys = [], [], [], []
                for _, s in wordhash.document_shingles(b.column(1), k):
                    least = signature(s)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    places.append((least >> np.uint32(16)).astype("<u2").tobytes())
                    grid = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
                    keys.append(wordhash.mix((grid * weights[:, :rows]).sum(axis=1, dtype=np.uint64) + weights[:, rows]).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(places, pa.binary()), listed], ["id", "n_shingles", "digest", "places", "bands"])

    return own.mapInArrow(run, schema)


class Signatures:
    """Compares places batch by batch."""

    def __init__(self, percent: int):
        self.least = least_matches(percent)

    def features(self, column: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u2") for x in column.to_pylist()]

    def ready(self, features: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
        grid = np.stack(features)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            equal = np.zeros(len(others), np.int64)
            for k, least in enumerate(self.least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal += (grid[others, part] == grid[i, part]).sum(axis=1)
                stay = equal >= least
                others, equal = others[stay], equal[stay]
                if not len(others):
                    break
            return others

        return similar


class Sets:
    """Confirms on full shingle sets."""

    def __init__(self, percent: int, k: int):
        self.percent, self.k = percent, k

    def features(self, column: pa.Array) -> list[np.ndarray]:
        return [s for _, s in wordhash.document_shingles(column, self.k)]

    def ready(self, features: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.array([len(f) for f in features], np.int64)
        known, codes = np.unique(np.concatenate(features), return_inverse=True)
        ends = np.cumsum(sizes)
        mark = np.zeros(len(known), bool)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
            others = others[(100 * small >= self.percent * large) & (small > 0)]
            if not len(others):
                return others
            own = codes[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            spans = sizes[others]
            first = np.cumsum(spans) - spans
            at = np.arange(spans.sum()) + np.repeat(ends[others] - spans - first, spans)
            shared = np.add.reduceat(mark[codes[at]].astype(np.int64), first)
            mark[own] = False
            return others[100 * shared >= self.percent * (spans + sizes[i] - shared)]

        return similar


def spanning_links(similar: Callable[[int, np.ndarray], np.ndarray], known: np.ndarray, pivots: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is similar, given components so far; each pivot meets the members of ``home`` it isn't connected with.

    They are stars: in each new component, the first member of every old one is linked with the very first.
    """
    part = known.copy()
    for i in pivots.tolist():
        others = home[part[home] != part[i]]
        if not len(others):
            continue
        for j in similar(i, others).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
    _, first = np.unique(known, return_index=True)
    centre: dict[int, int] = {}
    return [(centre[p], i) for i, p in sorted(zip(first.tolist(), part[first].tolist(), strict=True)) if centre.setdefault(p, i) != i]


def _linked(rows: DataFrame, matcher) -> DataFrame:
    """Links (a, b) inside each (grp, blk); ``visits`` rows are pivots that meet the block's own rows; without any, all meet."""
    kind = rows.schema["id"].dataType
    dealt = rows.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "id").select("grp", "blk", "id", "part", "visits", "payload")

    def solve(held: list[tuple]) -> Iterator[tuple]:
        if len(held) < 2:
            return
        ids, parts, visits = [h[0] for h in held], np.unique([h[1] for h in held], return_inverse=True)[1], np.array([h[2] for h in held])
        similar = matcher.ready([h[3] for h in held])
        pivots = np.flatnonzero(visits) if visits.any() else np.arange(len(held))
        for i, j in spanning_links(similar, parts, pivots, np.flatnonzero(~visits)):
            yield ids[i], ids[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, found, id_type = None, [], None

        def made() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([x[k] for x in found], id_type) for k in (0, 1)], ["a", "b"])
            found.clear()
            return out

        for whole in batches:
            id_type = whole.schema.field("id").type
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                features = matcher.features(b.column("payload"))
                columns = [b.column(c).to_pylist() for c in ("grp", "blk", "id", "part", "visits")]
                for *where, i, part, visits, feature in zip(*columns, features, strict=True):
                    if where != now:
                        found.extend(solve(held))
                        held.clear()
                        now = where
                    held.append((i, part, visits, feature))
                if len(found) > 5000:
                    yield made()
        found.extend(solve(held))
        if found:
            yield made()

    return dealt.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def link_groups(members: DataFrame, matcher, block: int = BLOCK, banded: bool = False) -> DataFrame:
    """Links (a, b) that connect the similar members of each group; ``members``: grp, size (of the group), id, payload.

    ``banded``: groups are bands, so those that are crowded need no visits (see above).
    """
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    home = F.pmod(F.xxhash64("id"), blocks).cast("int")
    alone = members.select("grp", home.alias("blk"), "id", F.col("id").alias("part"), F.lit(False).alias("visits"), "payload")
    first = cut(_linked(alone, matcher))
    large = cut(members.filter(F.col("size") > block))
    if large.isEmpty():
        return first
    parts = components(first)
    placed = large.join(parts, large["id"] == parts["node"], "left").select("grp", "size", "id", "payload", F.coalesce("component", "id").alias("part"))
    shares = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    visits = F.col("apart") * F.ceil(F.col("all") / F.lit(block))
    core = shares.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("core"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("apart"))
    core = cut(core.select("grp", "core", "all", (F.lit(banded) & (visits > CROWD * F.col("all"))).alias("crowded")))
    total = core.agg(F.sum("all")).first()[0]
    known = with_group_facts(placed, core, "grp", "all", total, ["id"]).withColumn("apart", F.col("part") != F.col("core"))
    calm = known.filter("NOT crowded")
    at_home = calm.select("grp", home.alias("blk"), "id", "part", F.lit(False).alias("visits"), "payload")
    guests = calm.filter("apart").select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"), "id", "part", home.alias("own"), "payload").filter("blk != own")
    visiting = guests.select("grp", "blk", "id", "part", F.lit(True).alias("visits"), "payload")
    links = first.union(cut(_linked(at_home.unionByName(visiting), matcher)))
    if not banded or core.filter("crowded").isEmpty():
        return links
    several = known.filter("crowded").groupBy("id").agg(F.sort_array(F.collect_set("grp")).alias("grps"), F.first("payload").alias("payload")).filter("size(grps) > 1")
    several = cut(several)  # a text has as many groups as there are bands, at most
    pairs = several.select("id", F.explode(F.flatten(F.transform("grps", lambda g, i: F.transform(F.slice("grps", i + 2, F.size("grps")), lambda h: F.xxhash64(g, h))))).alias("grp"))
    return links.union(link_groups(_sized(pairs).join(several.select("id", "payload"), "id").select("grp", "size", "id", "payload"), matcher, block))


def _sized(banded: DataFrame) -> DataFrame:
    """(grp, id, size) of the groups of two and more."""
    shared = cut(banded.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1"))
    total = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return with_group_facts(banded, shared, "grp", "size", total, ["id"], inner=True)


def groups(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``."""
    docs = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    rows = cut(sketch(docs, k, percent, text, key))
    usable = rows.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = cut(usable.groupBy("digest").agg(F.min("id").alias("rid"), F.count("*").alias("copies"), F.min_by(F.struct("places", "bands"), "id").alias("s")).select("digest", "rid", "copies", "s.places", "s.bands"))
    banded = _sized(classes.select(F.col("rid").alias("id"), F.explode("bands").alias("grp")))
    members = banded.join(classes.select(F.col("rid").alias("id"), F.col("places").alias("payload")), "id").select("grp", "size", "id", "payload")
    clusters = cut(components(link_groups(members, Signatures(percent), block, banded=True)))
    wanted = cut(_sized(clusters.select(F.col("node").alias("id"), F.col("component").alias("grp"))).select(F.col("id").alias(key), "grp", "size"))
    full = only_ids(docs, wanted, key).select("grp", "size", F.col(key).alias("id"), F.col(text).alias("payload"))
    final = components(link_groups(full, Sets(percent, k), block))
    named = cut(classes.join(final, classes["rid"] == final["node"], "left").select("digest", "copies", F.coalesce("component", "rid").alias("component_id")))
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = with_group_facts(rows.select("id", "n_shingles", "digest"), named, "digest", "copies", total, ["id"])
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id. Rows without an id stay too."""
    losers = cut(groups(docs, k, percent, text, key).filter(~F.col("kept") & F.col(key).isNotNull()).select(key).distinct())
    return without_ids(docs, losers, [key])
