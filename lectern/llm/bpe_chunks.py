"""BPE encoding that reuses content-defined chunks, and decoding.

1. A rolling hash of 32 bytes cuts every text into chunks at places that depend on the bytes around them only, so a passage
   shared by many documents gives the same chunks in all of them.
2. Chunks that occur more than once are found by their 128-bit digests (16 bytes a chunk shuffle, no text). The document
   with the smallest id that holds one encodes it, once.
3. A document without such chunks is encoded where it was read and never shuffles. The others get the ids of their shared
   chunks, encode only what lies between, and repair each join: the text around it is encoded again from the last safe
   place before it to the first one after it, one more place on either side until the new ids agree with the old ones there.
   A place is safe where an ASCII graphic character precedes ASCII white space: no pre-token spans it.

A chunk that a third of the documents share is no hot key: counts are summed before they shuffle, and the ids of the at most 1,000
chunks above 1/1000 of all uses (32 KB each at most; ids travel in two bytes where the vocabulary allows it) reach their documents by broadcast. A document's chunks are as many as it has.
Texts that shuffle travel compressed.

Texts that hold a special token's text are encoded whole. Null and empty texts have no ids. Very long texts have as many chunks as
they need, of at most 8 KB each, and are joined chunk by chunk. Rows with a null id, and
repeated rows, are encoded like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import tokens, wordhash
from lectern.llm.common import cut, free_name, membership_filter, with_group_facts, with_probe

MIN_CHUNK, MAX_CHUNK, MASK = 256, 8192, np.uint32(0x3FF << 20)
_GEAR = np.random.default_rng(61).integers(0, 1 << 32, 256, dtype=np.uint32)
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[33:127] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places at which a chunk may end, in order: a rolling hash of the 32 bytes before them has its mask bits clear."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        rolled = h.copy()
        rolled[k:] += h[:-k] << np.uint32(k)
        h = rolled
    return np.flatnonzero((h & MASK) == 0) + 1


def chunk_ends(data: np.ndarray, begin: int, end: int, places: np.ndarray) -> list[int]:
    """Ends of the chunks of the text data[begin:end]; they never split a character."""
    out, at = [], begin
    while at < end:
        k = int(np.searchsorted(places, at + MIN_CHUNK))
        stop = min(int(places[k]) if k < len(places) else end, at + MAX_CHUNK, end)
        while stop < end and data[stop] & 0xC0 == 0x80:
            stop += 1
        out.append(stop)
        at = stop
    return out


def chunks_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(row, bytes, ends of its chunks) of each text."""
    for row, data, bounds in wordhash.slices(texts):
        places = boundaries(data) if len(data) else np.zeros(0, np.int64)
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            yield row + i, data[a:b], [x - a for x in chunk_ends(data, a, b, places)]


def _digest(data: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(data)


class Joiner:
    """Encodes one text from spans whose ids are known or not."""

    def __init__(self, enc: tokens.Encoder):
        self.enc = enc

    def encode(self, data: np.ndarray, ends: list[int], known: list[np.ndarray | None]) -> np.ndarray:
        spans: list[tuple[int, int, np.ndarray | None]] = []
        begin = 0
        for end, ids in zip(ends, known, strict=True):
            if spans and ids is None and spans[-1][2] is None:
                spans[-1] = (spans[-1][0], end, None)
            else:
                spans.append((begin, end, ids))
            begin = end
        safe = np.flatnonzero(_BLANK[data[1:]] & _GRAPHIC[data[:-1]]) + 1
        whole, ids = 0, np.zeros(0, np.uint32)
        out: list[np.ndarray] = []  # ids before byte ``whole`` are settled and lie here; ``ids`` are those after it
        for begin, end, held in spans:
            right = (self._plain(data[begin:end]) if held is None else held).astype(np.uint32)
            if not begin:
                ids = right
                continue
            keep, joined = self._repair(data, safe, whole, begin, end, ids, right)
            if keep > 0:
                out.append(ids[:keep])
                whole += int(self.enc.lengths[ids[:keep]].sum())
            ids = joined
        return np.concatenate([*out, ids])

    def _plain(self, data: np.ndarray) -> np.ndarray:
        return self.enc.encode_plain(data.tobytes().decode("utf-8"))

    def _repair(self, data, safe, start, join, end, left, right) -> tuple[int, np.ndarray]:
        """(how many ids of ``left`` stay, the ids after them up to ``end``)."""
        left_at = start + np.concatenate([[0], np.cumsum(self.enc.lengths[left])])
        right_at = join + np.concatenate([[0], np.cumsum(self.enc.lengths[right])])
        k = int(np.searchsorted(safe, join))
        reach = 1
        while True:
            a, outer_a = (int(safe[k - n]) if k - n >= 0 and safe[k - n] > start else start for n in (reach, reach + 1))
            b, outer_b = (int(safe[k + n - 1]) if k + n - 1 < len(safe) and safe[k + n - 1] < end else end for n in (reach + 1, reach + 2))
            fresh = self._plain(data[outer_a:outer_b])
            fresh_at = outer_a + np.concatenate([[0], np.cumsum(self.enc.lengths[fresh])])
            i0, i1 = np.searchsorted(left_at, [outer_a, a])
            j0, j1 = np.searchsorted(right_at, [b, outer_b])
            f0, f1 = np.searchsorted(fresh_at, [a, b])
            aligned = left_at[i0] == outer_a and left_at[i1] == a and right_at[j0] == b and right_at[j1] == outer_b and fresh_at[f0] == a and fresh_at[f1] == b
            if aligned and np.array_equal(fresh[:f0], left[i0:i1]) and np.array_equal(fresh[f1:], right[j0:j1]):
                return int(i0), np.concatenate([fresh, right[j1:]])
            if outer_a == start and outer_b == end:
                return 0, fresh
            reach *= 2


class Digests:
    """The contract's digests of ids and of the decoded text."""

    def __init__(self, enc: tokens.Encoder):
        self.enc = enc
        self.decimals = [b"%d" % i for i in range(len(enc.bytes_of))]

    def of(self, ids: np.ndarray) -> tuple[int, str, str]:
        listed = ids.tolist()
        text = self.enc.decode_bytes(ids).decode("utf-8", "replace")
        return len(listed), hashlib.sha256(b",".join([self.decimals[i] for i in listed])).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def packed(rows: DataFrame) -> DataFrame:
    """(id, body) of rows (id, text): each text compressed for its way through a shuffle; a null text is empty."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            bodies = [pack.compress((x.as_py() or "").encode()) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(bodies, pa.binary())], ["id", "body"])

    return rows.select("id", "text").mapInArrow(tasks, T.StructType([rows.schema["id"], T.StructField("body", T.BinaryType())]))


def unpacked(bodies: pa.Array) -> pa.Array:
    """The texts of packed ones."""
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_py()).decode() for x in bodies], pa.string())


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, and its ids (binary, little-endian 32-bit) if asked for."""
    path = path or tokens.vocabulary_path()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    id_field = rows.schema["id"]
    special = list(tokens.encoder(path).special)
    width = "<u2" if len(tokens.encoder(path).bytes_of) <= 1 << 16 else "<u4"  # of ids that travel

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                owner, found = [], []
                for i, data, ends in chunks_of(b.column(1)):
                    own = {_digest(data[x:y]) for x, y in itertools.pairwise([0, *ends])}
                    owner += [i] * len(own)
                    found += own
                yield pa.record_batch([b.column(0).take(pa.array(owner, pa.int64())), pa.array(found, pa.binary())], ["id", "h"])

    plain = ~F.coalesce(F.greatest(*[F.instr("text", s) for s in special], F.lit(0), F.lit(0)) > 0, F.lit(False))
    seen = cut(rows.filter(plain).mapInArrow(digests, T.StructType([id_field, T.StructField("h", T.BinaryType())])))
    shared = cut(seen.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("owner")).filter("n > 1 AND owner IS NOT NULL"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uses = cut(with_group_facts(seen.filter("id IS NOT NULL"), shared, "h", "n", total, ["id"], inner=True).select("id", "h").distinct())
    flag = free_name(rows, "shares")
    holders = membership_filter(cut(uses.select(F.xxhash64("id").alias("slot")).distinct()))
    marked = with_probe(rows, F.xxhash64("id"), holders, flag)
    sharing = marked.filter(F.col(flag)).drop(flag)

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                wanted = b.column(2)
                made: dict[bytes, bytes] = {}
                for i, data, ends in chunks_of(unpacked(b.column(1))):
                    mine = set(wanted[i].as_py())
                    for x, y in itertools.pairwise([0, *ends]):
                        if (h := _digest(data[x:y])) in mine and h not in made:
                            made[h] = enc.encode_plain(data[x:y].tobytes().decode("utf-8")).astype(width).tobytes()
                yield pa.record_batch([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.binary())], ["h", "ids"])

    owned = cut(shared.groupBy(F.col("owner").alias("id")).agg(F.collect_list("h").alias("hs")))
    owners = with_probe(rows, F.xxhash64("id"), membership_filter(owned.select(F.xxhash64("id").alias("slot"))), flag).filter(F.col(flag))
    # a broadcast would put packing and encoding, two Python workers, into one task; "merge" keeps a shuffle between them
    table = cut(packed(owners).join(owned.hint("merge"), "id").select("id", "body", "hs").mapInArrow(encode_owned, "h binary, ids binary").groupBy("h").agg(F.first("ids").alias("ids")).join(shared.select("h", "n"), "h"))
    needed = with_group_facts(uses, table, "h", "n", total, ["id"], inner=True).groupBy("id").agg(F.collect_list("h").alias("hs"), F.collect_list("ids").alias("ids"))
    schema = T.StructType([T.StructField(key, id_field.dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        joiner, digest = Joiner(enc), Digests(enc)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                results, packed = [], []

                def done(ids: np.ndarray, results=results, packed=packed) -> None:
                    results.append(digest.of(ids))
                    if with_ids:
                        packed.append(ids.astype("<u4").tobytes())

                if b.num_columns == 2:
                    for body in b.column(1):
                        done(enc.encode(body.as_py() or ""))
                else:
                    texts = unpacked(b.column(1))
                    for i, data, ends in chunks_of(texts):
                        body = texts[i].as_py()
                        hs, ids = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                        if not hs or any(s in body for s in special):
                            done(enc.encode(body))
                            continue
                        known = dict(zip(hs, ids, strict=True))
                        raw = [known.get(_digest(data[x:y])) for x, y in itertools.pairwise([0, *ends])]
                        done(joiner.encode(data, ends, [None if r is None else np.frombuffer(r, width) for r in raw]))
                columns = [b.column(0), *(pa.array([r[k] for r in results], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                yield pa.record_batch([*columns, *([pa.array(packed, pa.binary())] if with_ids else [])], schema.names)

    joined = packed(sharing).join(needed.hint("merge"), "id", "left").select("id", "body", "hs", "ids").mapInArrow(assemble, schema)
    return marked.filter(~F.col(flag)).select("id", "text").mapInArrow(assemble, schema).unionByName(joined)
