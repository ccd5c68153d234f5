"""Finding text again: sentences as anchors, tolerant search, EPUB pointers for chunks, entity names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import plain_markup
from lectern.streaming.bucket_index import stored

LEAST_ENTRY, PROBE = 12, 40


def median_of(values: Column) -> Column:
    """The value at place n div 2 of the sorted array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def is_prose_page(line_widths: Column, page_width: Column, share: float = 0.5) -> Column:
    return F.coalesce(median_of(line_widths) >= page_width * share, F.lit(False))


def in_one_column(lefts: Column, within: float = 15, share: float = 0.6) -> Column:
    """Whether most rectangles begin near the median left edge."""
    near = F.size(F.filter(lefts, lambda x: F.abs(x - median_of(lefts)) <= within))
    return F.coalesce(near / F.nullif(F.size(lefts), F.lit(0)) >= share, F.lit(False))


def strip_running_head(text: str | None, label: str | None, rounds: int = 6, least: int = 40) -> str | None:
    """A sentence without leading capitals of a running head, its page label, separators and stray initials."""
    head = re.compile(rf"^(?:[A-ZÄÖÜ][A-ZÄÖÜ0-9/&.-]{{7,}}\s*|[A-ZÄÖÜ]\s+|{re.escape(label or chr(0))}[.)]?\s*|[|·•–—-]\s*)+")
    for _ in range(rounds if text else 0):
        found = head.match(text)
        if not found or len(text) - found.end() < least:
            break
        text = text[found.end() :]
    return text


@F.pandas_udf(T.StringType())
def running_head_off(text: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([strip_running_head(t, x) for t, x in zip(text, label, strict=True)], dtype=object)


def find_tolerant(text: str | None, needle: str | None) -> int:
    """Offset in ``text`` of ``needle`` with any white space between its words and any dash for a dash; -1 if it isn't there."""
    words = (needle or "").split()
    if not text or not words:
        return -1
    pattern = r"\s+".join(re.sub(r"(?:\\-|[‐-―])", "[-‐-―]", re.escape(w)) for w in words)
    found = re.search(pattern, text)
    return found.start() if found else -1


@F.pandas_udf(T.IntegerType())
def tolerant_offset(text: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([find_tolerant(t, n) for t, n in zip(text, needle, strict=True)])


def anchor_candidates(sentences: DataFrame, per_part: int = 5) -> DataFrame:
    """(doc, part, page, seq, text, rank): sentences that occur once in their document, by thirds of its pages, longest first.

    ``sentences``: doc, page, seq, text (of prose pages).
    """
    once = sentences.withColumn("n", F.count("*").over(W.partitionBy("doc", "text"))).filter("n = 1").drop("n")
    part = F.ntile(3).over(W.partitionBy("doc").orderBy("page", "seq"))
    placed = once.withColumn("part", F.element_at(F.array(F.lit("front"), F.lit("middle"), F.lit("back")), part))
    order = W.partitionBy("doc", "part").orderBy(F.desc(F.length("text")), "page", "seq")
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_part)


#: Sentences with one of these are no anchors, and none ends in such an abbreviation.
BOILERPLATE = "(?i)creativecommons|unrestricted reuse|distribution, and reproduction|doi\\.org|https?://|copyright|open access|alle rechte|verlag|impressum|isbn|auflage|gedruckt auf|herstellung"
ABBREVIATION_END = "(?:^|\\s)[a-zA-ZäöüÄÖÜ]{1,3}\\.$"
SENTENCE_START = "^[A-ZÄÖÜ0-9]"
POSITIONS = ("front", "middle", "back")
SPACES = "[\\x20\\x09-\\x0D]+"


def _sentence_facts(sentences: DataFrame, pages: DataFrame) -> DataFrame:
    """``sentences`` that may be anchors, with words and ``strict``. Probes, the second to fifth and third to sixth word, meet the
    hashed four-word windows of the document's pages in an equality join; a sentence with a probe on a second page is out."""
    w = F.filter(F.split("text", SPACES), lambda x: x != "")
    s = sentences.select("doc", "page", "seq", "in_column", F.array_join(w, " ").alias("text"), w.alias("w"))
    n = F.size("w")
    s = s.filter((n >= 6) & (n <= 45) & ~F.col("text").rlike(BOILERPLATE) & ~F.col("text").rlike(ABBREVIATION_END))
    window = lambda c, i: F.xxhash64(*[F.get(c, i + k) for k in range(-1, 3)])
    strict = (n >= 8) & F.col("text").rlike(SENTENCE_START) & ~F.col("text").rlike("[0-9]{3,}") & (F.array_max(F.transform("w", F.length)) >= 8)
    strict = strict & F.coalesce("in_column", F.lit(False))
    probes = F.array(window(F.col("w"), F.lit(2)), window(F.col("w"), F.lit(3)))
    s = stored(s.select("doc", "page", "seq", "text", n.alias("words"), strict.alias("strict"), probes.alias("probes")), "anchor-sentences")
    body = pages.select("doc", "page", F.filter(F.split("text", SPACES), lambda x: x != "").alias("w")).filter(F.size("w") >= 4)
    spots = body.select("doc", "page", F.explode(F.transform(F.array("w"), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 3), lambda i: window(c, i))))[0]).alias("h"))
    probes = s.select("doc", "page", "seq", F.explode("probes").alias("h"))
    asked = spots.join(probes.select("doc", "h").distinct(), ["doc", "h"], "left_semi").groupBy("doc", "h").agg(F.count("*").alias("pages"))
    seen = probes.join(asked, ["doc", "h"]).groupBy("doc", "page", "seq").agg(F.max("pages").alias("pages")).filter("pages = 1")
    spaced = pages.select("doc", "page", F.array_join(F.filter(F.split("text", SPACES), lambda x: x != ""), " ").alias("whole"))
    once = s.join(seen, ["doc", "page", "seq"], "left_semi").join(spaced, ["doc", "page"])
    once = once.filter(F.length("whole") - F.length(F.replace("whole", F.col("text"), F.lit(""))) == F.length("text"))
    return once.select("doc", "page", "seq", "text", "words", "strict")


def sample_anchors(sentences: DataFrame, pages: DataFrame, least_chars: int = 300, least_pages: int = 4) -> DataFrame:
    """(doc, position, rank, page, seq, text, relaxed): ranked anchors for the front, middle and back third of each document's body pages.

    ``sentences``: doc, page, seq, text, in_column; ``pages``: doc, page, text, prose. Body pages are prose of ``least_chars`` characters; a
    document with fewer than ``least_pages`` has no anchors. A position takes strict sentences (8 to 45 words, a capital first, no long
    number, a long word, in one column) of its own third, then of the rest of the body, page by page, longest first; if it has none,
    relaxed ones (6 words on), longest first. The page of a position's best anchor is no longer taken by later positions.
    """
    plain = F.length(F.array_join(F.filter(F.split("text", SPACES), lambda x: x != ""), " "))
    body = pages.filter(F.col("prose") & (plain >= least_chars)).select("doc", "page")
    by_page = W.partitionBy("doc").orderBy("page")
    placed = body.withColumns({"k": F.row_number().over(by_page) - 1, "n": F.count("*").over(W.partitionBy("doc"))}).filter(F.col("n") >= least_pages)
    third = F.floor(F.col("n") / 3)
    placed = placed.select("doc", "page", F.when(F.col("k") < third, 0).when(F.col("k") < F.floor(2 * F.col("n") / 3), 1).otherwise(2).alias("third"))
    pool = stored(_sentence_facts(sentences, pages).join(placed, ["doc", "page"]), "anchor-pool")  # positions look at it again and again
    out, used = [], None
    for at, position in enumerate(POSITIONS):
        free = pool if used is None else pool.join(used, ["doc", "page"], "left_anti")
        any_strict = F.bool_or("strict").over(W.partitionBy("doc"))
        taken = free.withColumn("any", any_strict).filter(F.col("strict") | ~F.col("any"))
        outside = F.when(F.col("any"), (F.col("third") != at).cast("int")).otherwise(0)
        first_page = F.when(F.col("any"), F.col("page"))
        order = W.partitionBy("doc").orderBy(outside, first_page, F.desc("words"), (F.col("third") != at).cast("int"), "page", "seq")
        ranked = taken.withColumn("rank", F.row_number().over(order)).select("doc", F.lit(position).alias("position"), "rank", "page", "seq", "text", (~F.col("any")).alias("relaxed"))
        out.append(ranked)
        best = ranked.filter("rank = 1").select("doc", "page")
        used = best if used is None else used.unionByName(best)
    return out[0].unionByName(out[1]).unionByName(out[2])


def pointers(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(chunk_id, cfi_start, cfi_end). ``chunks``: chunk_id, doc, text; ``entries``: doc, seq, cfi, text.

    A chunk begins at the first entry of its document whose beginning it holds (or that holds its own), and ends at the last
    one, by ends; entries under LEAST_ENTRY characters don't count. Without a match it gets the document's first entry.
    """
    tail = lambda x: F.when(F.length(x) > PROBE, F.substring(x, -PROBE, PROBE)).otherwise(x)
    ends = lambda c: [F.substring(c, 1, PROBE).alias("head"), tail(F.col(c)).alias("tail")]
    c = chunks.select("chunk_id", "doc", plain_markup(F.col("text")).alias("body")).select("*", (F.length("body") >= 20).alias("long"), *ends("body"))
    e = entries.select("doc", "seq", "cfi", plain_markup(F.col("text")).alias("entry")).select("*", *ends("entry"))
    # one row a document, so a chunk meets its document's entries where they lie and no pair is made into a row
    held = F.when(F.length("entry") >= LEAST_ENTRY, F.struct("seq", "cfi", "entry", "head", "tail"))
    own = e.groupBy("doc").agg(F.min_by("cfi", "seq").alias("first"), F.collect_list(held).alias("entries"))
    joined = c.join(own, "doc", "left")
    spot = lambda x: F.struct(x["seq"].alias("seq"), x["cfi"].alias("cfi"))
    begins = F.filter("entries", lambda x: F.contains("body", x["head"]) | (F.col("long") & F.contains(x["entry"], F.col("head"))))
    closes = F.filter("entries", lambda x: F.contains("body", x["tail"]) | (F.col("long") & F.contains(x["entry"], F.col("tail"))))
    found = joined.select("chunk_id", "first", F.array_min(F.transform(begins, spot)).alias("a"), F.array_max(F.transform(closes, spot)).alias("z"))
    start = F.coalesce("a.cfi", "first")
    return found.select("chunk_id", start.alias("cfi_start"), F.when(F.col("a.seq") <= F.col("z.seq"), F.col("z.cfi")).otherwise(start).alias("cfi_end"))


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, seq, name, entity): each name's entity by equal text, else by one holding the other (four characters on), else a new one.

    ``names``: doc, seq, name in order; ``known``: doc, seq, text. A new entity can be met by later names, so a document's
    names go through one function in order; a document bounds the group.
    """

    def resolve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = {" ".join(t.lower().split()): t for t in reversed(right.sort_values("seq")["text"].tolist())}
        order = [" ".join(t.lower().split()) for t in right.sort_values("seq")["text"]]
        out = []
        for r in left.sort_values("seq").itertuples():
            plain = " ".join(r.name.lower().split())
            near = next((k for k in order if len(plain) >= 4 and len(k) >= 4 and (plain in k or k in plain)), None)
            if plain not in index and near is None:
                index[plain] = r.name.strip()
                order.append(plain)
            out.append((r.doc, r.seq, r.name, index[plain] if plain in index else index[near]))
        return pd.DataFrame(out, columns=["doc", "seq", "name", "entity"])

    kinds = dict(names.dtypes)
    return names.groupBy("doc").cogroup(known.groupBy("doc")).applyInPandas(resolve, f"doc {kinds['doc']}, seq {kinds['seq']}, name string, entity string")


def sentence_rows(pages: DataFrame) -> DataFrame:
    """(doc, page, seq, text): spans of 25 to 600 characters that end a sentence; a lower-case letter after one means it goes on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, page, text in zip(frame["doc"], frame["page"], frame["text"], strict=True):
                seq = 0
                for m in re.finditer(r"[^.!?…]{25,600}?[.!?…](?=\s|$)", text or ""):
                    after = text[m.end() :].lstrip()[:1]
                    if not after or re.match(r"[„“”)‖\[A-ZÄÖÜ0-9*]", after):
                        rows.append((doc, page, seq, m[0].strip()))
                        seq += 1
            yield pd.DataFrame(rows, columns=["doc", "page", "seq", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("doc", "page", "text").mapInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, seq int, text string")
