"""Packed token files: best-fit-decreasing packing with a segment tree over free capacities.

Each task encodes its documents, cuts longer ones into pieces without losing an id, packs block after block of about
``BLOCK_IDS`` ids, and writes a file a block: the id matrix (rows of ``capacity``, padded), the cumulative lengths of the
segments of all rows with each row's share of them, and a bit a place that says where positions start again. Nothing
shuffles, memory is bounded by the block, and every block but the last of a task is packed almost full.

Files have a name of their own for each task attempt and only names that successful tasks returned are read back.
Null text counts as empty (its end id alone); a very long one is cut into pieces. Repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import tokens
from lectern.llm.common import fresh_dir, pin

CAPACITY = 2048
BLOCK_IDS = 1 << 22


class CapacityTree:
    """Open rows by free capacity: a segment tree over 0..capacity finds the smallest one that holds a piece."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.leaves
        while at:
            self.count[at] += 1
            at //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, its free capacity) of a fullest row with at least ``length`` free, which is then out of the tree."""
        at = length + self.leaves
        while not self.count[at]:
            while at & 1:  # a right child: its subtree's successors are further up
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        row = self.rows[free].pop()
        while at:
            self.count[at] -= 1
            at //= 2
        return row, free


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(row, offset) of each piece; longest first into the fullest row that holds it. Ties go in order of appearance."""
    tree, out, opened = CapacityTree(capacity), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found, opened = (opened, capacity), opened + 1
        row, free = found
        out[i] = (row, capacity - free)
        if free - lengths[i] > 0:
            tree.add(free - lengths[i], row)
    return out


def block_file(pieces: list[np.ndarray], keys: list[tuple], capacity: int, pad: int, width: str) -> bytes:
    """The file of one block; ``keys``: (document id or None, piece, start)."""
    places = pack([len(p) for p in pieces], capacity)
    rows = 1 + max((r for r, _ in places), default=-1)
    matrix = np.full((rows, capacity), pad, width)
    resets = np.zeros((rows, capacity), bool)
    order = sorted(range(len(pieces)), key=places.__getitem__)
    for i in order:
        row, at = places[i]
        matrix[row, at : at + len(pieces[i])] = pieces[i]
        resets[row, at] = True
    lengths = np.array([len(pieces[i]) for i in order], np.int64)
    row_of = np.array([places[i][0] for i in order], np.int64)
    out = io.BytesIO()
    np.savez(
        out,
        ids=matrix,
        cu_seqlens=np.concatenate([[0], np.cumsum(lengths)]),
        row_segments=np.searchsorted(row_of, np.arange(rows + 1)),
        position_resets=np.packbits(resets, axis=1),
        doc_id=np.array([keys[i][0] if keys[i][0] is not None else 0 for i in order], np.int64),
        doc_null=np.array([keys[i][0] is None for i in order], bool),
        piece=np.array([keys[i][1] for i in order], np.int32),
        start=np.array([keys[i][2] for i in order], np.int64),
    )
    return out.getvalue()


def positions(resets: np.ndarray) -> np.ndarray:
    """Position of each place in its segment, from a row's reset bits."""
    at = np.arange(resets.shape[-1])
    return at - np.maximum.accumulate(np.where(resets, at, 0), axis=-1)


def segments(blob: bytes) -> Iterator[tuple]:
    """(doc_id, piece, start, ids, row, offset) of each segment of a file, read from its own indexes."""
    with np.load(io.BytesIO(blob)) as f:
        ids, ends, shares = f["ids"], f["cu_seqlens"], f["row_segments"]
        resets = np.unpackbits(f["position_resets"], axis=1, count=ids.shape[1]).astype(bool)
        docs, nulls, piece, start = f["doc_id"], f["doc_null"], f["piece"], f["start"]
    for row in range(len(shares) - 1):
        place = positions(resets[row])
        base = ends[shares[row]]
        for k in range(shares[row], shares[row + 1]):
            a, b = int(ends[k] - base), int(ends[k + 1] - base)
            if not np.array_equal(place[a:b], np.arange(b - a)):
                raise ValueError(f"positions of row {row} don't start again at {a}")
            yield None if nulls[k] else int(docs[k]), int(piece[k]), int(start[k]), ids[row, a:b], row, a


def write(docs: DataFrame, base: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", end_id: int = tokens.END_ID, pad: int = tokens.END_ID, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``docs`` (whole-number ids) below ``base``; one row (path, rows, segments, ids) a file. Evaluate it once."""
    path = path or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        task = TaskContext.get()
        width = "<u2" if len(tokens.encoder(path).bytes_of) <= 1 << 16 else "<u4"
        pieces, keys, held, n = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.npz"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(name, compression=None) as out:
                out.write(block_file(pieces, keys, capacity, pad, width))
            made = pa.record_batch([pa.array([name]), pa.array([len(pieces)], pa.int64()), pa.array([held], pa.int64())], ["path", "segments", "ids"])
            pieces.clear()
            keys.clear()
            return made

        for b, i, ids in tokens.encoded(batches, 1, path, end_id):
            start, doc = 0, b.column(0)[i].as_py()
            for k, length in enumerate(tokens.cuts(len(ids), capacity)):
                pieces.append(ids[start : start + length].astype(width))
                keys.append((doc, k, start))
                start += length
            held += len(ids)
            if held >= block_ids:
                yield flush()
                held, n = 0, n + 1
        if pieces:
            yield flush()

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "path string, segments long, ids long")


def read(files: DataFrame, base: str, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, file, row, offset) of each segment of the files in the column ``path``."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("offset", T.LongType())])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    blob = f.read()
                name = path.rpartition("/")[2]
                rows = [(doc, piece, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name, row, at) for doc, piece, start, ids, row, at in segments(blob)]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], schema.names)

    return files.select("path").mapInArrow(run, schema)


def round_trip(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the packed files into the shared folder, and what they hold; each is read where it was written, so nothing shuffles."""
    base = fresh_dir(docs.sparkSession, "tokens")
    return read(pin(write(docs, base, capacity, text, key)), base, key)
