"""Token ids of a public byte-level BPE file, and the lossless cutting of documents into pieces.

The file is the JSON of the tokenizers library; encoding runs in tiktoken with ranks read from that file, which gives the
same ids several times faster (tests compare both, each code point included). The special token's text in a document
becomes its one id, as in the tokenizers library.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END_ID = 2
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """encode and decode with one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for token in self.special:
            ranks.pop(token.encode(), None)
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes_of[i] = token
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self._allowed = set(self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids as uint32; special tokens' texts count as those tokens."""
        return self.bpe.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())

    def encode_plain(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: one if they fit, else full pieces after a first that may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def encoded(batches: Iterator[pa.RecordBatch], at: int, path: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, ids) of each text; null text has no ids but the end's."""
    enc = encoder(path)
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    for b in batches:
        for i, text in enumerate(b.column(at)):
            body = text.as_py()
            yield b, i, np.concatenate([enc.encode(body), tail]) if body else tail


def piece_table(docs: DataFrame, capacity: int, text: str = "text", key: str = "doc_id", end_id: int | None = END_ID, path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece of every document; no shuffle."""
    path = path or vocabulary_path()
    rows = docs.select(key, text)
    schema = T.StructType([rows.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    arrow_key = {"long": pa.int64()}.get(rows.schema[key].dataType.typeName())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], [key, "piece", "start", "length", "ids_crc32"])
            for x in out:
                x.clear()
            return made

        kind = arrow_key
        for b, i, ids in encoded(batches, 1, path, end_id):
            kind = b.schema.field(0).type
            start, whole = 0, ids.astype("<u4")
            for k, n in enumerate(cuts(len(ids), capacity)):
                for column, value in zip(out, (b.column(0)[i].as_py(), k, start, n, zlib.crc32(whole[start : start + n].tobytes())), strict=True):
                    column.append(value)
                start += n
            if len(out[0]) >= 20_000:
                yield flush(kind)
        if out[0]:
            yield flush(kind)

    return rows.mapInArrow(run, schema)
