"""WARC archives: writer with revisit records, and a salvage reader.

Writer: each record is a gzip member of its own. Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one
with the smallest id is a response and the others revisit it; a record whose id equals that smallest one is a response too.
Smaller payloads are all responses. Null payloads are empty. Rows without an id are responses. Ids of any type are carried in
the record's address.

Reader: each member must decompress with a good check sum, begin with a version line, and agree with its Content-Length,
block digest and payload digest (SHA-1, SHA-256, SHA-512 or MD5, in hex or base32; digests with another label are reported, not
checked). After a failed check it searches for the next gzip member or version line from which a whole record can be read, goes
on there, and returns the bytes in between as a quarantined gap with the reason. Inside a member it does the same over the
decompressed bytes, those before a cut or a gzip error too; such a gap names them and has the member's place. From a member with
a gzip error come all records with a good block digest, and no others; as no digest covers headers, they are marked.

The search goes forward once, for members and version lines together, through a window of its own that is read again only
where it ends, so salvage reads at most three times the file's bytes, however many members are damaged. A member is decompressed
once if it has at most ``HOLD`` bytes, else a second time for its records, so readers hold a window or two and one record (or
what its header claims to be one, as far as its member or file goes), never a whole archive.

Files are written under a name of their own for each task attempt, and only the names that successful tasks returned are
read, each in a task of the one that wrote it, so a lost executor leaves at most files that nobody reads. A file ends after about
``FILE_BYTES``. An empty table gives no files and no rows; very long payloads are one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, fresh_dir, pin, with_group_facts, without_ids

REVISIT_FROM = 100
FILE_BYTES = 64 << 20
WINDOW = 1 << 20
HEAD = 1 << 16
HOLD = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_LONGEST_START = 11
_HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Digest labels and their sizes in bytes.
DIGESTS = {"sha1": 20, "sha256": 32, "sha512": 64, "md5": 16}


def record_uri(page_id) -> str:
    return f"urn:page:{quote(str(page_id), safe='')}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def id_of(uri: str | None) -> str | None:
    """The id in a record's address, if it has one."""
    return unquote(uri[9:]) if uri and uri.startswith("urn:page:") else None


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, length: int | None = None) -> bytes:
    """One record, not compressed; a revisit has no payload, but its ``length``."""
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_uri(page_id)}>",
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_uri(refers_to)}>"}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    end: int
    kind: str
    headers: dict[str, str]
    payload: bytes
    http_length: int | None
    unchecked: str | None = None


@dataclass
class Gap:
    offset: int
    end: int
    reason: str


class Damaged(Exception):
    pass


class Source:
    """Random access to a file: a window for the search and one for what is being read."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.held = {True: (0, b""), False: (0, b"")}

    def read(self, offset: int, n: int, search: bool = False) -> bytes:
        at, data = self.held[search]
        n = max(0, min(n, self.size - offset))
        if not (at <= offset and offset + n <= at + len(data)):
            self.file.seek(offset)
            at, data = offset, self.file.read(max(n, WINDOW))
            self.held[search] = at, data
        return data[offset - at : offset - at + n]

    def find(self, offset: int, lines_from: int) -> int:
        """Where the next member, or the next version line from ``lines_from`` on, may begin; the size if nowhere."""
        while offset < self.size:
            at, data = self.held[True]
            end = at + len(data)
            if not at <= offset < end or (offset + _LONGEST_START > end and end < self.size):
                self.read(offset, min(WINDOW, self.size - offset), search=True)
                continue
            for m in _START.finditer(data, offset - at):
                if m[0][0] == 0x1F or at + m.start() >= lines_from:
                    return at + m.start()
            offset = end if end == self.size else max(offset + 1, end - _LONGEST_START + 1)
        return self.size


class Plain:
    """Reads a file's bytes from ``start`` on."""

    def __init__(self, src: Source, start: int):
        self.src, self.start, self.size = src, start, src.size - start

    def read(self, offset: int, n: int) -> bytes:
        return self.src.read(self.start + offset, n)


class Held:
    """Reads bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]

    def forget(self, offset: int) -> None:
        """Nothing: the bytes are few."""


class Inflated:
    """Reads the first ``size`` decompressed bytes of a large member, forward from what isn't forgotten."""

    def __init__(self, src: Source, start: int, size: int):
        self.src, self.start, self.size = src, start, size
        self.base, self.data = 0, bytearray()
        self.parts = inflate(src, start)

    def read(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        while self.base + len(self.data) < offset + n:
            self.data += next(self.parts)[0]
        return bytes(self.data[offset - self.base : offset - self.base + n])

    def forget(self, offset: int) -> None:
        k = min(offset - self.base, len(self.data))
        if k >= WINDOW or k == len(self.data):
            del self.data[:k]
            self.base += k


def inflate(src: Source, offset: int) -> Iterator[tuple[bytes, int, str | None]]:
    """(decompressed bytes, place reached, end) of the member at ``offset``; end is '' at its proper end, else why it ends too early."""
    z, at = zlib.decompressobj(31), offset
    while True:
        part = src.read(at, 1 << 16)
        if not part:
            yield b"", at, "cut off"
            return
        before = z.copy()
        try:
            out = z.decompress(part)
        except zlib.error:
            z, out, step, k = before, b"", 512, 0
            while k < len(part):  # again in small steps, for what comes before the error
                before = z.copy() if step > 1 else z
                try:
                    out += z.decompress(part[k : k + step])
                    k += step
                except zlib.error:
                    if step == 1:
                        break
                    z, step = before, 1
            yield out, at + k, "gzip: bad data or check sum"
            return
        at += len(part)
        if z.eof:
            yield out, at - len(z.unused_data), ""
            return
        yield out, at, None


def _digest_of(told: str, data: bytes) -> bool | None:
    """Whether a digest field fits ``data``; None if there is none or its label isn't known."""
    label, colon, value = told.partition(":")
    label, value = label.strip().lower().replace("-", ""), value.strip()
    if not colon or label not in DIGESTS:
        return None
    want = hashlib.new(label, data, usedforsecurity=False).digest()
    if re.fullmatch(f"[0-9a-fA-F]{{{2 * DIGESTS[label]}}}", value):
        return value.lower() == want.hex()
    return value.upper().rstrip("=") == base64.b32encode(want).decode().rstrip("=")


def _record(r: Plain | Held | Inflated, at: int, offset: int, end: int) -> tuple[Record, int]:
    """The record at ``at`` of what ``r`` reads, and where it ends there."""
    n = HEAD
    while True:
        head = r.read(at, n)
        if not _LINE.match(head):
            raise Damaged("no version line")
        split = _HEAD_END.search(head)
        if split:
            break
        if at + n >= r.size:
            raise Damaged("no header end")
        n *= 2
    headers = {}
    for line in head[: split.start()].split(b"\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    told = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", told):
        raise Damaged("no content length")
    begin, length = at + split.end(), int(told)
    if begin + length > r.size:
        raise Damaged("shorter than its content length")
    block = r.read(begin, length)
    unchecked = [h for h in ("warc-block-digest", "warc-payload-digest") if headers.get(h) and _digest_of(headers[h], b"") is None]
    if _digest_of(headers.get("warc-block-digest", ""), block) is False:
        raise Damaged("block digest differs")
    http, payload = None, block
    if headers.get("content-type", "").startswith("application/http"):
        top = _HEAD_END.search(block)
        payload = block[top.end() :] if top else b""
        found = re.search(rb"(?im)^content-length:\s*(\d+)", block[: top.end()] if top else b"")
        http = int(found[1]) if found else None
    if headers.get("warc-type") != "revisit" and _digest_of(headers.get("warc-payload-digest", ""), payload) is False:
        raise Damaged("payload digest differs")
    stop = begin + length
    stop += len(re.match(rb"(\r?\n){0,2}", r.read(stop, 4))[0])
    return Record(offset, end, headers.get("warc-type", ""), headers, payload, http, ", ".join(unchecked) or None), stop


def _next_line(r: Held | Inflated, at: int) -> int:
    while at < r.size:
        part = r.read(at, HEAD)
        if m := _LINE.search(part):
            return at + m.start()
        at += max(1, len(part) - _LONGEST_START + 1) if at + len(part) < r.size else len(part)
    return r.size


def _inside(r: Held | Inflated, offset: int, end: int, doubtful: bool) -> Iterator[Record | Gap]:
    """Whole records of a member in order, and a gap for each run between them; of ``doubtful`` members only those with digests."""
    at, bad, why = 0, None, ""
    while at < r.size:
        r.forget(at)
        try:
            one, stop = _record(r, at, offset, end)
            told = one.headers.get("warc-block-digest", "")
            if doubtful and _digest_of(told, b"") is None:
                raise Damaged("no block digest in a damaged member")
            if doubtful:
                one.unchecked = ", ".join(filter(None, (one.unchecked, "headers, of a damaged member")))
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next_line(r, at + 1)
            continue
        if bad is not None:
            yield Gap(offset, end, f"decompressed bytes {bad} to {at}: {why}")
            bad = None
        yield one
        at = stop
    if bad is not None:
        yield Gap(offset, end, f"decompressed bytes {bad} to {at}: {why}")


def _member(src: Source, offset: int) -> tuple[Held | Inflated, int, str]:
    """(reader of the member at ``offset``, where it ends, why it ends too early or '')."""
    held, size = bytearray(), 0
    for part, at, early in inflate(src, offset):
        size += len(part)
        if held is not None:
            held += part
            if size > HOLD:
                held = None
    return (Inflated(src, offset, size) if held is None else Held(bytes(held))), at, early


def salvage(file, size: int) -> Iterator[Record | Gap]:
    """Every whole record in order, and a gap for each run of bytes that none of them covers."""
    src = Source(file, size)
    at, bad, why = 0, None, ""
    while at < size:
        early, lead = "", src.read(at, _LONGEST_START)
        try:
            if lead.startswith(b"\x1f\x8b\x08"):
                reader, end, early = _member(src, at)
                found = _inside(reader, at, end, early.startswith("gzip"))
                held: list[Record | Gap] = []  # gaps before the first record
                for x in found:
                    held.append(x)
                    if isinstance(x, Record):
                        break
                else:
                    raise Damaged(early or (held[0].reason if held else "empty member"))
            elif _LINE.match(lead):
                one, n = _record(Plain(src, at), 0, at, 0)
                end = one.end = at + n
                held, found = [one], iter(())
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = src.find(at + 1, at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield from held
        yield from found
        if early:  # the next member may begin before the error shows
            at = src.find(at + 1, end)
            if end < at:
                bad, why = end, early
        else:
            at = end
    if bad is not None:
        yield Gap(bad, size, why)


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def write_archives(pages: DataFrame, base: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, payload, digest, refers_to, payload_bytes) as archives below ``base``; one row (path, records) a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(base)
        task = TaskContext.get()
        stem, made, out, written, count = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}", [], None, 0, 0
        for b in batches:
            for row in zip(*(b.column(k) for k in range(6)), strict=True):
                page_id, url, payload, digest, refers_to, length = (x.as_py() for x in row)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{stem}-{len(made):04d}.warc.gz"
                    out = fs.open_output_stream(path, compression=None)
                data = gzip_member(record_bytes(page_id, url, payload or b"", digest, refers_to, length))
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= file_bytes:
                    out.close()
                    made.append((path, count))
                    out, written, count = None, 0, 0
        if out is not None:
            out.close()
            made.append((path, count))
        if made:
            yield pa.record_batch([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "payload_bytes").mapInArrow(run, "path string, records long")


def read_archives(files: DataFrame, base: str) -> DataFrame:
    """One row a record, and one a gap (kind ``gap``, with its reason), of the files in the column ``path``.

    ``page_id`` and ``refers_to`` are ids as text, null where the address holds none; ``unchecked`` names digests of unknown labels.
    """
    schema = "path string, offset long, end long, kind string, record_id string, page_id string, refers_to string, payload_bytes long, payload_digest string, unchecked string, reason string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 3]

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (path, x.offset, x.end, "gap", *[None] * 6, x.reason)
        uri, to = x.headers.get("warc-record-id", "").strip("<>"), x.headers.get("warc-refers-to", "").strip("<>")
        if x.kind == "revisit":
            told = x.http_length, x.headers.get("warc-payload-digest", "").removeprefix("sha256:")
        else:
            told = len(x.payload), hashlib.sha256(x.payload).hexdigest()
        return (path, x.offset, x.end, x.kind, uri, id_of(uri), id_of(to), *told, x.unchecked, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(base)
        rows: list[tuple] = []
        made = lambda: pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    for x in salvage(f, f.size()):
                        rows.append(row(path, x))
                        if len(rows) >= 5000:
                            yield made()
                            rows.clear()
        if rows:
            yield made()

    return files.select("path").mapInArrow(run, schema)


def with_revisits(pages: DataFrame, payload: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, payload_bytes): who revisits whom. Payloads don't shuffle.

    Revisits are decided on (id, digest, length), cut once, and need no payload. The responses are the other rows, kept where
    they are read but for what two membership filters in turn flag for nothing.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("page_id"), "url", raw.alias("payload"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("payload_bytes"))
    thin = cut(rows.select("page_id", "digest", "payload_bytes", "url"))
    counted = thin.filter(F.col("payload_bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(counted.filter("n > 1"))
    kind = rows.schema["page_id"].dataType
    total = groups.agg(F.sum("n")).first()[0]
    if total is None:
        return rows.withColumn("refers_to", F.lit(None).cast(kind))
    known = with_group_facts(thin, groups, "digest", "n", total, ["page_id"], inner=True).filter("first < page_id")
    revisits = cut(known.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "payload_bytes", F.col("first").alias("refers_to")))
    others = without_ids(rows, revisits.select("page_id", "digest"), ["page_id", "digest"], thin)
    return others.withColumn("refers_to", F.lit(None).cast(kind)).unionByName(revisits)


def round_trip(pages: DataFrame, payload: str = "html", key: str = "page_id") -> DataFrame:
    """Write ``pages`` as archives, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    base, kind = fresh_dir(pages.sparkSession, "warc"), pages.schema[key].dataType
    files = pin(write_archives(with_revisits(pages, payload, key), base))
    back = read_archives(files, base).filter("kind IN ('response', 'revisit')")
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM q"""
