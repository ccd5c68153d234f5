"""Periodic runs of words, found by matching aligned blocks, and texts with the runs collapsed.

A run is a stretch of words with smallest period q (words q apart are identical), of at least max(6, 4 q) words, that no
neighbouring word extends. Periods are looked for by scale: those from b to 2 b - 1, b a power of two. A run of such a period
holds a block of b words that begins at a multiple of b, lies within its first 2 q words and occurs again q words later. So the
blocks at multiples of b are keys of an Aho-Corasick automaton over word numbers, which is searched across the document; only
occurrences b to 2 b - 1 words behind their block can belong to a run. What the match implies for 3 q words is tested by
prefix hashes (a stretch of period d whose first d words are no power of a shorter stretch), which leaves a few seeds a block at
most; each seed is then extended word by word in both directions, so what is reported is exact. A block can only be a seed if each of
its words recurs within 2 b words; in prose such blocks are rare, and no automaton is made without one.

Memory is bounded by the text: keys above LONGEST words are cut to so many (the tests and the extension see all), and a
document is searched by segments of SEGMENT words with what follows, each with an automaton of its own, in pieces of PIECE words.

A null or empty text has no words and no runs. Very long texts are searched whole; a text of one repeated word is one run. No row
moves or meets another, so repeated rows, equal ids and an empty table need no rule; a null id leaves a text as it is where ids decide about
edits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 6, 4
LONGEST, SEGMENT, PIECE = 1 << 8, 1 << 17, 1 << 14
_BASE = 0x9E3779B97F4A7C15


class _Prefix:
    """Hashes of stretches of a sequence in constant time."""

    def __init__(self, ids: np.ndarray):
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        self.up = np.full(len(ids) + 1, _BASE, np.uint64)
        self.up[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` items from ``a`` are likely those from ``b``, a <= b."""
        return (self.sums[a + size] - self.sums[a]) * self.up[b - a] == self.sums[b + size] - self.sums[b]


def _matches(ids: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, occurrence) where the block of ``size`` words at a start occurs ``size`` to 2 ``size`` - 1 words later."""
    key_size = min(size, LONGEST)
    each = max(1, SEGMENT // key_size)
    for k in range(0, len(starts), each):
        own = starts[k : k + each]
        for group in np.split(own, np.flatnonzero(np.diff(own) > SEGMENT) + 1):  # no search between distant blocks
            automaton, blocks = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
            for start in group.tolist():
                key = tuple(ids[start : start + key_size].tolist())
                held = automaton.get(key, None)
                if held is None:
                    held = len(blocks)
                    automaton.add_word(key, held)
                    blocks.append([])
                blocks[held].append(start)
            automaton.make_automaton()
            begin, end = int(group[0]) + size, int(group[-1]) + 2 * size - 1 + key_size
            found: list[list[int]] = [[] for _ in blocks]
            for low in range(begin, end - key_size + 1, PIECE):
                for last, which in automaton.iter(tuple(ids[low : min(low + PIECE + key_size - 1, end)].tolist())):
                    found[which].append(low + last - key_size + 1)
            pairs = []
            for at, hits in zip(blocks, found, strict=True):
                at, hits = np.array(at), np.array(hits, np.int64)
                low, high = np.searchsorted(hits, at + size), np.searchsorted(hits, at + 2 * size)
                count = high - low
                begins = np.repeat(at, count)
                pairs.append((begins, hits[np.arange(len(begins)) - np.repeat(np.cumsum(count) - count - low, count)]))
            yield tuple(map(np.concatenate, zip(*pairs, strict=True)))


def _least_factors(most: int) -> np.ndarray:
    """The least prime factor of each number up to ``most``."""
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    return out


def _primitive(prefix: _Prefix, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretch is no repetition of a shorter one."""
    out = np.ones(len(start), bool)
    factors = _least_factors(int(size.max(initial=1)))
    rest = size.copy()
    while (rest > 1).any():
        step = np.where(rest > 1, size // factors[rest], size)
        out &= (step == size) | ~prefix.equal(start, start + step, size - step)
        rest //= factors[rest]
    return out


def _same_for(ids: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal those ``distance`` later."""
    done, size = 0, 64
    while True:
        low, high = (at + done, min(at + done + size, len(ids) - distance)) if step > 0 else (max(at - done - size + 1, 0), at - done + 1)
        if high <= low:
            return done
        same = ids[low:high] == ids[low + distance : high + distance]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done, size = done + high - low, 2 * size


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of whole numbers, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    out, prefix, size = [], None, 1
    while REPEATS * size <= n:
        near = np.zeros(n + 1, np.int64)
        np.cumsum(gap < 2 * size, out=near[1:])
        starts = np.arange(0, n - 3 * size + 1, size)
        starts = starts[near[starts + size] - near[starts] == size]
        if out:  # inside a run of a shorter period nothing has a longer one
            furthest = np.zeros(n, np.int64)
            np.maximum.at(furthest, [r[0] for r in out], [r[0] + r[1] for r in out])
            starts = starts[np.maximum.accumulate(furthest)[starts] < starts + 6 * size]
        if len(starts):
            prefix = prefix or _Prefix(ids)
            reach: dict[int, int] = {}  # where the last run of a period ends
            seeds: list[tuple[int, int]] = []
            for at, hit in _matches(ids, starts, size):
                d = hit - at
                inside = at + 3 * d <= n
                at, d = at[inside], d[inside]
                cubes = prefix.equal(at, at + d, 2 * d)
                at, d = at[cubes], d[cubes]
                whole = _primitive(prefix, at, d)
                seeds += zip(at[whole].tolist(), d[whole].tolist(), strict=True)
            for at, d in sorted(seeds):
                if at + 3 * d <= reach.get(d, 0):
                    continue
                ahead = _same_for(ids, at, d, 1)
                start = at - _same_for(ids, at - 1, d, -1)
                length = at + ahead - start + d
                reach[d] = start + length
                if length >= max(LEAST, REPEATS * d):
                    out.append((start, length, d))
        size *= 2
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds behind its first period, joined by a space."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


def _over_texts(df: DataFrame, key: str, text: str, schema: pa.Schema, spark_schema: str, work: Callable[[object, str | None], list[dict]]) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, body in zip(batch.column(0), batch.column(1), strict=True):
                out += work(id_.as_py(), body.as_py())
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).mapInArrow(tasks, spark_schema).withColumnRenamed("id", key)


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, period), a row a run of every text."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "start", "length", "period")])

    def work(id_: object, body: str | None) -> list[dict]:
        return [{"id": id_, "start": s, "length": n, "period": p} for s, n, p in runs(numbered(words_of(body)))]

    return _over_texts(df, key, text, schema, "id long, start long, length long, period long", work)


def collapsed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, collapsed_text) of every row: its words joined by a space, each run once."""

    def work(id_: object, body: str | None) -> list[dict]:
        words = words_of(body)
        return [{"id": id_, "collapsed_text": collapse(words, runs(numbered(words))).decode("utf-8", "surrogatepass")}]

    return _over_texts(df, key, text, pa.schema([("id", pa.int64()), ("collapsed_text", pa.string())]), "id long, collapsed_text string", work)


def planted(id_: int | None, words: list[bytes]) -> list[bytes]:
    """The words, made periodic from some place on where the id's checksum says so."""
    n = len(words)
    checksum = zlib.crc32(str(id_).encode())
    if id_ is None or not n or checksum % 10:
        return words
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def digest(id_: int | None, body: str | None) -> dict:
    """What the registered query says of a text with planted repetition."""
    words = planted(id_, words_of(body))
    found = runs(numbered(words))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    out = {"id": id_, "n_runs": len(found), "start": None, "length": None, "period": None, "exponent_milli": None}
    if best:
        out |= {"start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2]}
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return out | {"runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapse(words, found)).hexdigest()}


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row, with planted repetition."""
    numbers = ("id", "n_runs", "start", "length", "period", "exponent_milli")
    schema = pa.schema([(c, pa.int64()) for c in numbers] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")])
    spark_schema = ", ".join(f"{c} long" for c in numbers) + ", runs_sha256 string, collapsed_sha256 string"
    return _over_texts(df, key, text, schema, spark_schema, lambda id_, body: [digest(id_, body)])
