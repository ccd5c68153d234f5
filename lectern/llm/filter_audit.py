"""Filter interaction audit: what each of five filters removes, first, after others or alone, in all 120 orders.

Four filters look at a text alone and are one native projection; the fifth, an earlier equal text, is decided on digests of
the rows that a counting filter of all texts can't clear (see ``exact_dedup``). A document is then a mask of five bits.
``mapInArrow`` looks the masks up in a table of 32 masks x 120 orders, the step that removes such a document (5: none), and
``np.bincount`` adds them up by part, label, order and step. A task returns one array of 24 counts a part and order, so what is
shuffled grows with tasks x parts x 120, whatever share of the rows one part holds. Everything else follows from these counts: the
documents that fail a filter at all are those it removes as first, those that fail no other are those it removes as last.

A null text is empty, a null part is the empty string. A document without words fails A only; an empty one is equal to other
empty or null ones. Rows are documents, so repeated rows count each; rows that repeat an id as well as a text fail E only if
a smaller id has that text. A null id is neither smaller nor larger than another and has no label. A document of several labels is
good (toxic) if one of them says so. Very long texts are judged whole; an empty table has no parts and gives no rows. Only the
named columns are read, so others of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import cut, let, membership_filter, with_group_facts, with_probe
from lectern.llm.exact_dedup import repeated_slots, slot_of

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS)
#: Labels are bits: 1 good, 2 toxic. A part has LABELS x orders x (steps + kept) counts.
LABELS = 4
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows looked up at once, and parts that a task holds before it passes its counts on.
SLICE, HELD = 1024, 256


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, whose filter a document of that mask fails first; 5 if it fails none."""
    bits = np.array([[1 << LETTERS.index(x) for x in order] for order in ORDERS])
    failed = (np.arange(1 << STEPS)[:, None, None] & bits) > 0
    return np.where(failed.any(2), failed.argmax(2), STEPS).astype(np.int64)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D for a text that isn't null."""
    words = F.array_remove(F.split(text, SPACES), "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    by_words = let(counts, lambda c: (c["all"] < 100).cast("int") + 2 * (100 * c["distinct"] < 80 * c["all"]).cast("int"))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return by_words + 4 * (100 * upper.cast("long") > 10 * F.length(text)).cast("int") + 8 * text.rlike("[#$%&*|]").cast("int")


def masks(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, mask, label) of every row of ``df``; the text is read once."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    thin = cut(df.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(body).alias("own"),
        slot_of(body).alias("slot"), F.unhex(F.sha2(body, 256)).alias("digest"),
    ))
    repeated, total = repeated_slots(thin.select("slot"))
    marked = with_probe(thin, F.col("slot"), membership_filter(repeated), "suspect").drop("slot")
    suspects = marked.filter("suspect").drop("suspect")
    groups = cut(suspects.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    copies = with_group_facts(suspects, groups, "digest", "n", total, ["id"]).select("id", "part", "digest", (F.col("own") + 16 * later).alias("mask"))
    alone = marked.filter("NOT suspect").select("id", "part", "digest", F.col("own").alias("mask"))
    said = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((said("quality") + 2 * said("toxic")).alias("label"), F.count("*").alias("said"))
    return with_group_facts(alone.unionByName(copies), known, "id", "said", total, ["digest"]).select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, order, counts[label, step]) of the batches' rows (part, mask, label)."""
    table, wide = first_failures(), len(ORDERS) * (STEPS + 1)
    at = np.arange(len(ORDERS)) * (STEPS + 1)
    held: dict[str, np.ndarray] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for name, counts in held.items():
            by_order = np.ascontiguousarray(counts.reshape(LABELS, len(ORDERS), STEPS + 1).transpose(1, 0, 2))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(ORDERS) + 1) * LABELS * (STEPS + 1), pa.int32()), pa.array(by_order.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ORDERS)), pa.array(range(len(ORDERS)), pa.int32()), cells], ["part", "filter_order", "counts"])
        held.clear()

    for batch in batches:
        coded = batch["part"].dictionary_encode()
        codes, mask, label = (x.to_numpy(zero_copy_only=False) for x in (coded.indices, batch["mask"], batch["label"]))
        for i in range(0, len(codes), SLICE):
            found, own = np.unique(codes[i : i + SLICE], return_inverse=True)
            cell = (own * LABELS + label[i : i + SLICE])[:, None] * wide + at + table[mask[i : i + SLICE]]
            counts = np.bincount(cell.ravel(), minlength=len(found) * LABELS * wide).reshape(len(found), -1)
            for k, code in enumerate(found):
                name = coded.dictionary[int(code)].as_py()
                held[name] = held[name] + counts[k] if name in held else counts[k].copy()
            if len(held) > HELD:
                yield from passed_on()
    yield from passed_on()


def audit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row a part, order and step."""
    partial = masks(df, labels, text, key, part).mapInArrow(tally, "part string, filter_order int, counts array<long>")
    cells = [(label, step) for label in range(LABELS) for step in range(STEPS + 1)]
    summed = partial.groupBy("part", "filter_order").agg(*[F.sum(F.col("counts")[i]).alias(f"c{label}{step}") for i, (label, step) in enumerate(cells)])

    def count(steps: range, labels: tuple[int, ...] = (0, 1, 2, 3)) -> Column:
        out = F.lit(0).cast("long")
        for step in steps:
            for label in labels:
                out = out + F.col(f"c{label}{step}")
        return out

    names = F.array(*map(F.lit, ORDERS))
    rows = summed.select("part", names[F.col("filter_order")].alias("filter_order"), F.inline(F.array(*[
        F.struct(
            F.lit(s + 1).alias("step"), count(range(s + 1, STEPS + 1)).alias("kept"), count(range(s, s + 1)).alias("removed"),
            count(range(s, s + 1), (1, 3)).alias("good_lost"), count(range(s, s + 1), (2, 3)).alias("toxic_lost"),
        )
        for s in range(STEPS)
    ])))
    # a filter has 120 rows a part
    own = W.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    fails, alone = (F.max(F.when(F.col("step") == s, F.col("removed"))).over(own) for s in (1, STEPS))
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"),
    )


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
f AS (SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails,
             doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT filter_order, list_transform(string_split(filter_order, ''), lambda x: ascii(x) - 64) AS steps FROM o),
g AS (SELECT part, filter_order, steps, fails, n, good, toxic,
             coalesce(list_position(list_transform(steps, lambda i: fails[i]), true), 6) AS first FROM c, p),
r AS (SELECT part, filter_order, s AS step, steps[s] AS filter,
             coalesce(sum(n) FILTER (first > s), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = s), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (fails[steps[s]] AND first < s), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails[steps[s]] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (first = s), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (first = s), 0)::BIGINT AS toxic_lost
      FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY part, filter_order, s, steps[s])
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r"""
