"""File sources: content hashes, and EPUB archives as chapters, spine and text pointers."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, mtime_ms, content, content_hash); the hash is the key of idempotent work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content", F.sha2("content", 256).alias("content_hash"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def spine(blob: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of an EPUB's chapters in reading order."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        hrefs = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if _local(e.tag) == "item"}
        names = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), hrefs[e.attrib["idref"]])) for e in package.iter() if _local(e.tag) == "itemref" and e.attrib.get("idref") in hrefs]
        present = set(z.namelist())
        return [(n, z.read(n)) for n in names if n in present]


#: Elements that hold a block of text.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "pre")


def text_blocks(chapter: bytes, index: int) -> Iterator[tuple[str, str, str]]:
    """(pointer, tag, text): element steps are even numbers, chapter i of the spine is step 2 (i + 1)."""
    try:
        root = ElementTree.fromstring(chapter)
    except ElementTree.ParseError:
        return

    def walk(node, path: str) -> Iterator[tuple[str, str, str]]:
        for k, child in enumerate(node):
            if not isinstance(child.tag, str):
                continue
            step = f"{path}/{2 * (k + 1)}"
            text = " ".join("".join(child.itertext()).split())
            if _local(child.tag) in BLOCKS and text:
                yield f"epubcfi(/6/{2 * (index + 1)}!{step})", _local(child.tag), text
            else:
                yield from walk(child, step)

    yield from walk(root, "")


def epub_blocks(files: DataFrame) -> DataFrame:
    """(path, chapter, seq, cfi, tag, text) of every text block of every archive; archives that can't be read give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, blob in zip(frame["path"], frame["content"], strict=True):
                try:
                    chapters = spine(blob)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    continue
                for i, (_, body) in enumerate(chapters):
                    rows += [(path, i, seq, *block) for seq, block in enumerate(text_blocks(body, i))]
            yield pd.DataFrame(rows, columns=["path", "chapter", "seq", "cfi", "tag", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, chapter int, seq int, cfi string, tag string, text string")


def epub_markdown(blob: bytes) -> str:
    """Chapters as plain paragraphs; headings keep their level."""
    out = []
    for i, (_, body) in enumerate(spine(blob)):
        for _, tag, text in text_blocks(body, i):
            out.append(f"{'#' * int(tag[1])} {text}" if re.fullmatch("h[1-6]", tag) else html.unescape(text))
    return "\n\n".join(out)


def page_markers(c: Column) -> Column:
    """Page landmarks of a converted EPUB (an anchor named ..._page_P) as {P-1} marker paragraphs; echoes [P] go."""
    parts = F.split(c, "(?=<[^>]*_page_[0-9]+[^>]*>)")
    number = lambda p: F.regexp_extract(p, "^<[^>]*_page_([0-9]+)", 1)
    rest = lambda p: F.regexp_replace(p, "^<[^>]*_page_[0-9]+[^>]*>(</[a-z]+>)?(\\\\?\\[[0-9]+\\\\?\\])?", "")
    marked = F.transform(parts, lambda p: F.when(number(p) != "", F.concat(F.lit("\n\n{"), (number(p).cast("int") - 1).cast("string"), F.lit("}" + "-" * 48 + "\n\n"), rest(p))).otherwise(p))
    return F.array_join(marked, "")


def has_tables(lines: DataFrame, key: str, page: str, line: str) -> DataFrame:
    """(key, has_table): at least two signs on the first three pages: tabs, aligned columns, table words."""
    head = lines.filter(F.col(page) < 3)
    words = F.col(line).rlike("(?i)\\b(table|tabelle|figure|abbildung)\\b")
    facts = head.groupBy(key).agg(F.sum(F.regexp_count(line, F.lit("\t"))).alias("tabs"), F.count_if(F.col(line).rlike("\\S {3,}\\S+ {3,}\\S")).alias("aligned"), F.count_if(words).alias("words"))
    signs = (F.col("tabs") > 5).cast("int") + (F.col("aligned") > 5).cast("int") + (F.col("words") > 2).cast("int")
    return facts.select(key, (signs >= 2).alias("has_table"))
