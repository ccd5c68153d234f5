"""Recall without moving the corpus: queries go to the scan, documents stay where they are read.

The queries' terms (or vectors) are one small table of bounded size, sent to every task once. A task scores its documents as it
reads them and keeps the best k a query, ties by id; only these leave it, so what shuffles is tasks x queries x k rows, whatever
the corpus holds and however frequent a term is. ``fits`` tells whether the queries are small enough; ``search`` joins postings
or meets in blocks where they aren't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of query side that are sent to tasks, and numbers that a task works on at once, whatever a batch holds.
MOST_BYTES, CELLS = 64 << 20, 1 << 18


class Best:
    """The best ``k`` (score, id) of each query so far, smaller ids first among equal scores.

    What is added waits until it is as much as is held, so many small additions cost no more sorting than a few large ones.
    """

    def __init__(self, k: int, queries: int):
        self.k, self.floor, self.parts, self.waiting, self.kept = k, np.full(queries, -np.inf), [], 0, 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[query]
        if keep.any():
            self.parts.append((query[keep], ids[keep], score[keep]))
            self.waiting += int(keep.sum())
        if self.waiting >= max(CELLS // 8, self.kept):
            self.held()

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query, id, score) in that order, None if there is nothing."""
        if self.waiting:
            query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((ids, -score, query))
            query, ids, score = query[order], ids[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.floor)))[query]
            last = place == self.k - 1
            self.floor[query[last]] = score[last]
            keep = place < self.k
            self.parts, self.waiting, self.kept = [(query[keep], ids[keep], score[keep])], 0, int(keep.sum())
        return self.parts[0] if self.parts else None


def _parts(batch: pa.RecordBatch, lists: str) -> Iterator[pa.RecordBatch]:
    """Stretches of whole rows with about CELLS list elements."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch[lists]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _hits(best: list[Best], queries: list, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for arm, found in enumerate(best):
        if (held := found.held()) is None:
            continue
        query, ids, score = held
        columns = [pa.array(np.full(len(query), arm, np.int32)), pa.array([queries[q] for q in query], types[0]), pa.array(ids.tolist(), types[1]), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["arm", "query_id", "id", "score"])


def _types(queries: DataFrame, rows: DataFrame) -> tuple[str, list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [queries.schema["query_id"].dataType, rows.schema["id"].dataType]
    return f"arm int, query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double", [to_arrow_type(t) for t in kinds]


@dataclass
class Asked:
    """The distinct terms of all queries and, a query, the numbers of its terms, distinct and (the heaviest) for the sparse arm."""

    ids: list
    terms: list[str]
    distinct: list[list[int]]
    heaviest: list[list[int]]


def asked_terms(bags: DataFrame, most_terms: int) -> Asked | None:
    """From (query_id, bag of terms); None if the table of terms x queries is beyond MOST_BYTES. Heaviest: most frequent, then by name."""
    n, total = bags.agg(F.count("*"), F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()
    if 8 * n * total > 64 * MOST_BYTES:  # even if most terms are repeated
        return None
    known: dict[str, int] = {}
    ids, distinct, heaviest = [], [], []
    for r in bags.collect():
        counts: dict[str, int] = {}
        for t in r["bag"] or []:
            counts[t] = counts.get(t, 0) + 1
        number = {t: known.setdefault(t, len(known)) for t in counts}
        ids.append(r["query_id"])
        distinct.append(list(number.values()))
        heaviest.append([number[t] for t in sorted(counts, key=lambda t: (-counts[t], t))[:most_terms]])
    return Asked(ids, list(known), distinct, heaviest) if 8 * len(ids) * max(1, len(known)) <= MOST_BYTES else None


def _counted(bag: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of known terms, by row, and the length of each row's bag."""
    lengths = pc.fill_null(pc.list_value_length(bag), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.fill_null(pc.index_in(bag.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)[codes >= 0]
    cells, counts = np.unique(rows * max(1, len(known)) + codes[codes >= 0], return_counts=True)
    return cells // max(1, len(known)), cells % max(1, len(known)), counts, lengths


def _corpus(bags: DataFrame, known) -> tuple[np.ndarray, int, float]:
    """(documents a term, documents, mean length): one scan, a few rows a task."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(known.value, pa.string())
        frequency, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in (part for whole in batches for part in _parts(whole, "bag")):
            _, term, _, lengths = _counted(batch["bag"], terms)
            frequency += np.bincount(term, minlength=len(terms))
            n, total = n + len(lengths), total + int(lengths.sum())
        held = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(frequency[held], [n, total]))], ["term", "n"])

    frequency, totals = np.zeros(len(known.value), np.int64), {-1: 0, -2: 0}
    for r in bags.mapInArrow(tasks, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row an asked term
        if r["term"] < 0:
            totals[r["term"]] = r["n"]
        else:
            frequency[r["term"]] = r["n"]
    return frequency, totals[-1], totals[-2] / max(1, totals[-1])


def lexical(asked: Asked, queries: DataFrame, bags: DataFrame, k: int, k1: float, b: float, pivot: float, arms: tuple[str, ...]) -> DataFrame:
    """(arm, query_id, id, score): each task's best ``k`` of the arms "bm25" and "sparse"; ``bags``: id, bag of terms.

    Weights of a document's terms are tf / (tf + norm), or w / (w + pivot) of half a term's count.
    """
    spark = bags.sparkSession
    known = spark.sparkContext.broadcast(asked.terms)
    frequency, n, mean = _corpus(bags.select("bag"), known) if "bm25" in arms else (np.zeros(len(asked.terms)), 0, 0.0)
    wanted = {}
    for arm, of in (("bm25", asked.distinct), ("sparse", asked.heaviest)):
        if arm in arms:
            wanted[arm] = np.zeros((len(asked.terms), len(asked.ids)))
            for q, terms in enumerate(of):
                wanted[arm][terms, q] = 1.0
    if "bm25" in arms:
        wanted["bm25"] *= np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))[:, None]
    sent = spark.sparkContext.broadcast([wanted[a] for a in arms])
    ids, (schema, types) = asked.ids, _types(queries, bags)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, best = pa.array(known.value, pa.string()), [Best(k, len(ids)) for _ in arms]
        step = max(1, CELLS // max(1, len(ids)))
        for batch in (part for whole in batches for part in _parts(whole, "bag")):
            row, term, tf, lengths = _counted(batch["bag"], terms)
            own, begin = _ids(batch["id"]), 0
            while begin < len(row):  # whole documents, about CELLS numbers at once
                end = len(row) if begin + step >= len(row) else int(np.searchsorted(row, row[begin + step - 1], "left"))
                end = end if end > begin else int(np.searchsorted(row, row[begin], "right"))
                r, t, f = row[begin:end], term[begin:end], tf[begin:end]
                firsts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                for arm, matrix, found in zip(arms, sent.value, best, strict=True):
                    weight = f / (f + k1 * (1 - b + b * lengths[r] / mean)) if arm == "bm25" else f * 0.5 / (f * 0.5 + pivot)
                    scores = np.round(np.add.reduceat(weight[:, None] * matrix[t], firsts, axis=0), 6)
                    at, query = np.nonzero((scores > 0) & (scores >= found.floor))
                    found.add(query, own[r[firsts]][at], scores[at, query])
                begin = end
        yield from _hits(best, ids, types)

    return bags.mapInArrow(tasks, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame | None:
    """(arm, query_id, id, score): each task's best ``k`` by cosine, None if the queries' vectors are beyond MOST_BYTES.

    ``queries``: query_id, vector; ``rows``: id, vector. Zero and null vectors and those of another length match nothing.
    """
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if 8 * n * (width or 1) > MOST_BYTES:
        return None
    held = queries.filter(F.col("vector").isNotNull()).collect()
    spark = rows.sparkSession
    with np.errstate(invalid="ignore", divide="ignore"):
        asked = np.array([r["vector"] for r in held], np.float64).reshape(len(held), width or 1)
        sent = spark.sparkContext.broadcast(asked / np.linalg.norm(asked, axis=1, keepdims=True))
    ids, (schema, types) = [r["query_id"] for r in held], _types(queries, rows)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, best = sent.value, Best(k, len(ids))
        step = max(1, CELLS // max(1, len(ids), unit.shape[1]))
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["vector"]), unit.shape[1]), False))
            own, vectors = _ids(batch["id"]), batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), unit.shape[1])
            for begin in range(0, len(batch) if ids else 0, step):
                part = vectors[begin : begin + step]
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = np.round(unit @ (part / np.linalg.norm(part, axis=1, keepdims=True)).T, 6)
                    query, at = np.nonzero(scores >= best.floor[:, None])
                best.add(query, own[begin + at], scores[query, at])
        yield from _hits([best], ids, types)

    return rows.select("id", "vector").mapInArrow(tasks, schema)


def most_shared(wanted: list[list], rows: DataFrame, k: int) -> DataFrame:
    """(number, id, links): each task's best ``k`` of ``rows`` (id, terms) by the terms they share with ``wanted[number]``, smaller ids first.

    ``terms`` are distinct, and a task reads its rows in the order of their ids: of rows with equally many links the earlier stays.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = rows.sparkSession, to_arrow_type(rows.schema["terms"].dataType.elementType)
    known = sorted({t for w in wanted for t in w})
    code = {t: i for i, t in enumerate(known)}
    cells = np.array(sorted((code[t], n) for n, w in enumerate(wanted) for t in set(w)), np.int64).reshape(-1, 2)
    sent = spark.sparkContext.broadcast((known, np.searchsorted(cells[:, 0], np.arange(len(known) + 1)), cells[:, 1].copy()))
    n, id_type = len(wanted), to_arrow_type(rows.schema["id"].dataType)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, firsts, numbers = sent.value
        terms, best, seen, ids = pa.array(known, kind), Best(k, n), 0, {}
        for batch in batches:
            row, term, _, _ = _counted(batch["terms"], terms)
            size, width = np.bincount(row, minlength=len(batch)), firsts[term + 1] - firsts[term]
            ends, begin = np.cumsum(width), 0
            while begin < len(row):  # whole rows, about CELLS pairs at once
                last = min(int(np.searchsorted(ends, ends[begin] - width[begin] + CELLS)), len(row) - 1)
                end = len(row) if row[last] == row[-1] else int(np.searchsorted(row, row[last], "left"))
                end = end if end > begin else int(np.searchsorted(row, row[begin], "right"))
                w, r = width[begin:end], np.repeat(row[begin:end], width[begin:end])
                q = numbers[np.arange(len(r)) + np.repeat(firsts[term[begin:end]] - np.cumsum(w) + w, w)]
                may = size[r] > best.floor[q]
                found, links = np.unique(r[may] * n + q[may], return_counts=True)
                more = links > best.floor[found % n]
                best.add(found[more] % n, seen + found[more] // n, links[more].astype(np.float64))
                begin = end
            if (held := best.held()) is not None:
                own = batch["id"]
                ids = {r: own[r - seen].as_py() if r >= seen else ids[r] for r in np.unique(held[1]).tolist()}
            seen += len(batch)
        if (held := best.held()) is not None:
            query, held, links = held
            columns = [pa.array(query.astype(np.int32)), pa.array([ids[r] for r in held.tolist()], id_type), pa.array(links.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["number", "id", "links"])

    return rows.select("id", "terms").sortWithinPartitions("id").mapInArrow(tasks, f"number int, id {dict(rows.dtypes)['id']}, links long")
