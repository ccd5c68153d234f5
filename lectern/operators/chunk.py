"""Documents to chunks. Rules that look back at earlier paragraphs run per document in one pass over its rows, Arrow-batched.

Paragraphs end at blank lines. A heading is a paragraph whose first line begins with one to six # and a blank. Tokens are the
whole part of 1.3 a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BLANK_LINES = re.compile(r"\n\s*\n+")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_MARKER = re.compile(r"^\{(\d+)\}-{3,}$")
#: Characters of chunks that a task gathers before it hands them on.
MOST_CHARS = 1 << 20
#: Where an oversized text is split, in this order.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ")


def paragraphs(c: Column) -> Column:
    """Trimmed paragraphs in order, without empty ones."""
    parts = F.transform(F.split(c, "\n[\\x09-\\x0D\\x20]*\n+"), lambda p: F.regexp_replace(p, "^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$", ""))
    return F.filter(parts, lambda p: p != "")


def windows(items: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` items, each beginning ``size - overlap`` after the one before; the last reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window")
    n = F.size(items)
    last = F.greatest(n - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.slice(items, s + 1, F.lit(size)))).otherwise(F.transform(F.array().cast("array<int>"), lambda s: items))


def tokens_of(text: str) -> int:
    return int(len(text.split()) * 1.3)


def heading_of(paragraph: str) -> tuple[int, str] | None:
    found = _HEADING.match(paragraph.strip().split("\n")[0].strip())
    return (len(found[1]), found[2].strip()) if found else None


def trail_by_level(trail: list[tuple[int, str]], level: int, title: str) -> list[tuple[int, str]]:
    """Headings of the same and deeper levels end; gaps between levels stay."""
    return [x for x in trail if x[0] < level] + [(level, title)]


def trail_by_depth(trail: list[tuple[int, str]], level: int, title: str) -> list[tuple[int, str]]:
    """At most level - 1 headings stay, whatever their levels."""
    return trail[: level - 1] + [(level, title)]


@dataclass
class Piece:
    text: str
    headings: list[str]
    first: int
    last: int
    pages: list[tuple[int, str]] = field(default_factory=list)


def split_large(text: str, most: int, overlap: int) -> list[str]:
    """Halve a text that is too large at the best separator, else at a word; the right half repeats ``overlap`` words of the left."""
    if tokens_of(text) <= most:
        return [text]

    def halves() -> tuple[str, str] | None:
        for sep in SEPARATORS:
            parts = text.split(sep)
            if len(parts) < 2:
                continue
            fits = (k for k in range(len(parts) // 2, 0, -1) if tokens_of(sep.join(parts[:k])) <= most)
            k = next(fits, None)
            if k is None or not sep.join(parts[:k]):
                over = next((k for k in range(1, len(parts)) if tokens_of(sep.join(parts[:k])) > most), None)
                if over is None:
                    continue
                k = max(1, over - 1)
            left, right = sep.join(parts[:k]), sep.join(parts[k:])
            if left and right:
                tail = left.split()[-overlap:] if overlap else []
                return left, f"{' '.join(tail)} {right}" if tail else right
        words = text.split()
        if len(words) > most:
            mid = len(words) // 2
            return " ".join(words[:mid]), " ".join(words[mid - overlap :])
        return None

    pair = halves()
    if pair is None or any(tokens_of(x) >= tokens_of(text) for x in pair):
        return [text]
    return [x for half in pair for x in split_large(half, most, overlap)]


def _bounds_of(whole: str, parts: list[str], pages: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """Page bounds of each part, with offsets from its own beginning; a part that isn't found keeps the first page."""
    out, at = [], 0
    for part in parts:
        probe = part if part in whole else part[-min(len(part), 200) :]
        found = whole.find(probe, at)
        begin = max(0, found - (len(part) - len(probe))) if found >= 0 else at
        current = [label for offset, label in pages if offset <= begin][-1:] or [label for _, label in pages[:1]]
        inner = [(offset - begin, label) for offset, label in pages if begin < offset < begin + len(part)]
        out.append([(0, label) for label in current] + inner)
        at = max(at, begin + 1)
    return out


def budget_chunks(text: str | None, most: int = 512, overlap: int = 50, least: int = 50, trail: Callable = trail_by_level) -> list[Piece]:
    """Chunks that begin at headings or when the budget is full.

    A new chunk repeats the last ``overlap`` words of the paragraph before it, if that has more. A text over the budget is
    split; a last chunk below ``least`` tokens joins the one before. Page markers {n}--- set the page of what follows.
    """
    heads: list[tuple[int, str]] = []
    page, index = "1", -1
    out: list[Piece] = []
    held: list[str] = []
    state = Piece("", [], 0, 0)

    def emit(last: bool) -> None:
        body = "\n\n".join(held)
        if last and out and tokens_of(body) < least:
            out[-1].text += "\n\n" + body
            out[-1].last = state.last
            return
        parts = split_large(body, most, overlap)
        for part, pages in zip(parts, _bounds_of(body, parts, state.pages) if len(parts) > 1 else [state.pages], strict=True):
            out.append(Piece(part, state.headings, state.first, state.last, pages))

    for raw in _BLANK_LINES.split(text or ""):
        paragraph = raw.strip()
        if not paragraph:
            continue
        if marker := _MARKER.match(paragraph):
            page = str(int(marker[1]) + 1)
            continue
        index += 1
        head = heading_of(paragraph)
        if head:
            heads = trail(heads, *head)
        if held and (head or sum(map(tokens_of, held)) + tokens_of(paragraph) > most):
            emit(last=False)
            words = held[-1].split()
            carried = [" ".join(words[-overlap:])] if overlap and len(words) > overlap else []
            state = Piece("", [h[1] for h in heads], index, index, [(0, state.pages[-1][1])] if carried else [])
            held = carried
        elif not held:
            state = Piece("", [h[1] for h in heads], index, index)
        if not state.pages or state.pages[-1][1] != page:
            state.pages.append((len("\n\n".join(held)) + (2 if held else 0), page))
        held.append(paragraph)
        state.last = index
    if held:
        emit(last=True)
    return out


def plain_chunks(text: str | None, most: int = 512) -> list[Piece]:
    """Chunks that begin at headings or when the budget is full, without overlap or splitting; trails by depth."""
    out: list[Piece] = []
    heads: list[tuple[int, str]] = []
    page, index, used = "1", -1, 0
    for raw in _BLANK_LINES.split(text or ""):
        paragraph = raw.strip()
        if not paragraph:
            continue
        if marker := _MARKER.match(paragraph):
            page = str(int(marker[1]) + 1)
            continue
        index += 1
        head = heading_of(paragraph)
        if head:
            heads = trail_by_depth(heads, *head)
        cost = tokens_of(paragraph)
        if not out or head or used + cost > most:
            out.append(Piece(paragraph, [h[1] for h in heads], index, index, [(0, page)]))
            used = cost
            continue
        piece = out[-1]
        if piece.pages[-1][1] != page:
            piece.pages.append((len(piece.text) + 2, page))
        piece.text += "\n\n" + paragraph
        piece.last, used = index, used + cost
    return out


def chunk_table(docs: DataFrame, key: str, text: str, chunker: Callable[[str | None], list[Piece]] = budget_chunks) -> DataFrame:
    """(key, chunk_index, text, section_titles, first_paragraph, last_paragraph, token_count, paragraph_pages) of all documents."""
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, chunk_index int, text string, section_titles array<string>, first_paragraph int, last_paragraph int, token_count int, paragraph_pages array<struct<offset:int,label:string>>"
    arrow = to_arrow_schema(T.DataType.fromDDL(schema))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for k, body in zip(batch[key], batch[text], strict=True):  # a text at a time
                for i, p in enumerate(chunker(body.as_py())):
                    rows.append((k.as_py(), i, p.text, p.headings, p.first, p.last, tokens_of(p.text), [{"offset": o, "label": s} for o, s in p.pages]))
                    held += len(p.text)
                if held >= MOST_CHARS:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return docs.select(key, text).mapInArrow(run, schema)


def embedding_input(text: Column, titles: Column) -> Column:
    """What a chunk's vector is made of: its section line, if it has one, and the text."""
    return F.when(F.size(titles) > 0, F.concat(F.lit("> Section: "), F.array_join(titles, " > "), F.lit("\n\n"), text)).otherwise(text)
