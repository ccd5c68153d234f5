"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Texts and templates are sequences of words: runs of ASCII letters and digits and of non-ASCII characters, A-Z folded. Every
template's k-word hashes are winnowed (the least of each window) into an inverted index from hash to (template, place); the
index is as large as the templates, so each task has it whole. Every k-word hash of every document is looked up, which finds
any shared run of K + WINDOW - 1 words. Of templates below LONG words every hash is indexed, of pairs of words where ``percent``
of the words may hold no whole run of K. Hits of one template on nearby diagonals make a candidate, which is aligned in a band
around them (match 1, mismatch and gap -1) unless too few of its words occur in the band at all. A candidate is reported if
the words matched are at least ``percent`` of the template's.

Names of licenses differ by a word or two, and so do their headers and texts. Of reports of one of these kinds that lie mostly
in each other the one with more matches stays, then the one that covers more of its template.

Null and empty texts give no rows, like texts without a match, and an empty table gives none; very long texts are scanned whole, each
candidate in a band of its own. Of alignments of equal score the one with more matches wins, then the later first word; of overlapping
reports of one template the one with more matches stays, then the leftmost. Repeated rows are reported as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import wordhash

K, WINDOW, BAND = 3, 3, 8
PERCENT = 70
LONG = 100

#: Kinds of templates, by the end of their names, of which only one is right for a place.
KINDS = ("name", "header", "conditions", "text")
#: Public license notices; whole texts, headers and parts are in the folder ``licenses``.
TEMPLATES = {
    "mit-name": "Released under the MIT License.",
    "apache-2.0-name": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-name": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-name": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-name": "Released under the ISC License.",
    "bsd-name": "Released under the BSD License.",
    "bsd-2-clause-name": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-name": "Licensed under the BSD 3-Clause License.",
    "mpl-2.0-name": "Licensed under the Mozilla Public License, Version 2.0.",
    "gpl-2.0-name": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-name": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-name": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-name": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc0-1.0-name": "Released under the CC0 1.0 Universal Public Domain Dedication.",
    "cc-by-4.0-name": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-name": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-name": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-name": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-name": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-4.0-header": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-header": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
} | {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def word_hashes(text: str) -> np.ndarray:
    data = _CLEAN[np.frombuffer(text.encode(), np.uint8)]
    return wordhash.words_of(data, np.array([0, len(data)]))[0]


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: the rightmost least hash of each window, each once."""
    places: list[int] = []
    for a in range(max(1, len(hashes) - window + 1)):
        part = hashes[a : a + window]
        at = a + len(part) - 1 - int(np.argmin(part[::-1]))
        if not places or places[-1] != at:
            places.append(at)
    return places


class Index:
    """The inverted index of the templates."""

    def __init__(self, templates: dict[str, str], percent: int = PERCENT):
        self.names = sorted(templates)
        self.words = [word_hashes(templates[n]) for n in self.names]
        short = [n for n, w in zip(self.names, self.words, strict=True) if len(w) < K]
        if short:
            raise ValueError(f"templates of fewer than {K} words: {short}")
        entries: dict[int, list[tuple[int, int, int]]] = {K: [], K - 1: []}
        for t, w in enumerate(self.words):
            k = seed_size(len(w), percent)
            grams = wordhash.shingles(w, k)
            entries[k] += [(int(grams[p]), t, p) for p in (range(len(grams)) if len(w) < LONG else winnow(grams))]
        self.seeds = {k: (np.array([e[0] for e in sorted(es)], np.uint64), [e[1:] for e in sorted(es)]) for k, es in entries.items() if es}

    def hits(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Places in ``grams``, of k words each, that the index has."""
        keys = self.seeds[k][0]
        at = np.searchsorted(keys, grams)
        return np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == grams)

    def postings(self, k: int, gram: np.uint64) -> list[tuple[int, int]]:
        keys, posts = self.seeds[k]
        return posts[np.searchsorted(keys, gram, "left") : np.searchsorted(keys, gram, "right")]


def seed_size(n: int, percent: int) -> int:
    """K, or one less for a template of ``n`` words whose wrong words can break up every run of K."""
    wrong = n * (100 - percent) // 100
    return K if n >= LONG or n - wrong > (K - 1) * (wrong + 1) else K - 1


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...], percent: int) -> Index:
    return Index(dict(templates), percent)


def most_matches(doc: np.ndarray, template: np.ndarray, low: int, high: int, start: int, stop: int) -> int:
    """No alignment in the band matches more: words of the template that the band has at all."""
    first, n, width = low - BAND, len(template), high - low + 2 * BAND + 1
    a, z = max(first, start), min(first + n + width - 1, stop)
    part, there = np.zeros(n + width - 1, np.uint64), np.zeros(n + width - 1, bool)
    if z > a:
        part[a - first : z - first], there[a - first : z - first] = doc[a:z], True
    windows = np.lib.stride_tricks.sliding_window_view
    return int(((windows(part, width) == template[:, None]) & windows(there, width)).any(axis=1).sum())


#: Cells of an alignment are one number: score, matches and the first word (counted from the band's first row), 21 bits each.
_MATCH, _SCORE = 1 << 21, 1 << 42
#: Rows of a band worked out together.
ROWS = 1 << 12


def align(doc: np.ndarray, template: np.ndarray, low: int, high: int, start: int = 0, stop: int | None = None) -> tuple[int, int, int]:
    """(matches, first word, end word) of the best local alignment of doc[start:stop] on diagonals low - BAND .. high + BAND (document - template).

    A match scores 1, anything else -1; of equal scores more matches win, then the later first word, then the earlier end. A row of
    the band, kept by diagonal, is worked out at once: gaps along it are a running maximum.
    """
    stop, n, width = len(doc) if stop is None else stop, len(template), high - low + 2 * BAND + 1
    begin, end = max(start, low - BAND), min(stop, high + BAND + n)
    best, best_end = 0, begin
    cells, other = np.zeros(width, np.int64), np.empty(width, np.int64)
    slope = np.arange(width) * _SCORE
    for first in range(begin, end, ROWS):
        i = np.arange(first, min(first + ROWS, end))
        j = i[:, None] - (high + BAND) + np.arange(width)
        same = (j >= 0) & (j < n) & (template[np.clip(j, 0, n - 1)] == doc[i, None])
        gain = np.where(same, _SCORE + _MATCH, -_SCORE)
        opened = np.where(same, _SCORE + _MATCH + (i - begin)[:, None], 0)
        rows = np.zeros((len(i), width), np.int64)
        for row, more, fresh in zip(rows, gain, opened, strict=True):
            np.add(cells, more, out=row)
            np.maximum(row, fresh, out=row)
            np.subtract(cells, _SCORE, out=other)  # the word of the document left out
            np.maximum(row[:-1], other[1:], out=row[:-1])
            row += slope
            np.maximum.accumulate(row, out=row)  # words of the template left out
            row -= slope
            row *= row >= _SCORE
            cells = row
        tops = rows.max(axis=1)
        if (most := int(tops.max())) > best:
            best, best_end = most, int(i[tops.argmax()]) + 1
    return best % _SCORE // _MATCH, begin + best % _MATCH, best_end


def align_all(doc: np.ndarray, template: np.ndarray, low: int, high: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """Alignments of at least ``percent`` of the template: the best one, then those before and after it."""
    parts = [(max(0, low - BAND), min(len(doc), high + BAND + len(template)))]
    while parts:
        start, stop = parts.pop()
        if 100 * (stop - start) < percent * len(template) or 100 * most_matches(doc, template, low, high, start, stop) < percent * len(template):
            continue
        matches, begin, end = align(doc, template, low, high, start, stop)
        if 100 * matches >= percent * len(template):
            yield matches, begin, end
            parts += [(start, begin), (end, stop)]


def scan_words(doc: np.ndarray, seeds: list[tuple[int, int, np.uint64]], index: Index, percent: int) -> list[tuple[int, int, int, int]]:
    """(template, matches, first word, end word) of each report; ``seeds``: (words, place, hash) of the hits."""
    lines: dict[int, list[tuple[int, int]]] = {}
    for k, p, gram in seeds:
        for t, q in index.postings(k, gram):
            lines.setdefault(t, []).append((p, p - q))
    out = []
    for t, hits in sorted(lines.items()):
        template = index.words[t]
        hits.sort(key=lambda x: (x[1], x[0]))
        found, low, high = set(), hits[0][1], hits[0][1]
        for _, diagonal in [*hits[1:], (0, hits[-1][1] + 2 * BAND + len(template) + 1)]:
            if diagonal - high > BAND or diagonal - low > 2 * BAND:
                found.update((-matches, begin, end) for matches, begin, end in align_all(doc, template, low, high, percent))
                low = diagonal
            high = diagonal
        taken: list[tuple[int, int]] = []
        for matches, begin, end in sorted(found):
            if all(end <= a or begin >= b for a, b in taken):
                taken.append((begin, end))
                out.append((t, -matches, begin, end))
    return sorted(best_of_kind(out, index), key=lambda x: (x[2], x[0]))


def best_of_kind(found: list[tuple[int, int, int, int]], index: Index) -> list[tuple[int, int, int, int]]:
    """Without reports that lie by more than half in a better one of their kind."""
    out: list[tuple[int, int, int, int]] = []
    kept: dict[str, list[tuple[int, int]]] = {}
    for t, matches, begin, end in sorted(found, key=lambda x: (-x[1], len(index.words[x[0]]), x[0], x[2])):
        kind = index.names[t].rpartition("-")[2]
        spans = kept.setdefault(kind, [])
        if kind not in KINDS or all(2 * (min(end, z) - max(begin, a)) <= end - begin for a, z in spans):
            spans.append((begin, end))
            out.append((t, matches, begin, end))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(key, template, matched_words, template_words, coverage, first_word, end_word, first_char, end_char); no shuffle."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    whole = ("matched_words", "template_words", "coverage", "first_word", "end_word", "first_char", "end_char")
    fields = [T.StructField("template", T.StringType()), *(T.StructField(c, T.DoubleType() if c == "coverage" else T.LongType()) for c in whole)]
    schema = T.StructType([rows.schema[0], *fields])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(tuple(sorted(templates.items())), percent)
        for b in batches:
            owner: list[int] = []
            found: list[tuple] = []
            for row, raw, bounds in wordhash.slices(b.column(1)):
                data = _CLEAN[raw] if len(raw) else raw
                hashes, start, end, first = wordhash.words_of(data, bounds)
                if len(hashes) < K:
                    continue
                seeds: dict[int, list[tuple[int, int, np.uint64]]] = {}
                for k in index.seeds:
                    grams = wordhash.shingles(hashes, k)
                    hits = index.hits(k, grams)
                    doc_of = np.searchsorted(first, hits, "right") - 1
                    inside = hits + k <= first[doc_of + 1]
                    for p, i in zip(hits[inside].tolist(), doc_of[inside].tolist(), strict=True):
                        seeds.setdefault(i, []).append((k, p - int(first[i]), grams[p]))
                for i in sorted(seeds):
                    a, z = int(first[i]), int(first[i + 1])
                    for t, matches, begin, stop in scan_words(hashes[a:z], seeds[i], index, percent):
                        c0, c1 = int(start[a + begin]), int(end[a + stop - 1])
                        before = int(((raw[bounds[i] : c0] & 0xC0) != 0x80).sum())
                        span = int(((raw[c0:c1] & 0xC0) != 0x80).sum())
                        size = len(index.words[t])
                        owner.append(row + i)
                        found.append((index.names[t], matches, size, matches / size, begin, stop, before, before + span))
            yield pa.record_batch([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array([x[k] for x in found], t) for k, t in enumerate(kinds))], schema.names)

    return rows.mapInArrow(run, schema)
