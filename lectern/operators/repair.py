"""Label repair: what is wrong with a book's page labels, which new label ranges would be right, and which locators follow.

Pages count from 0. A label spec is an array of ranges (startpage, prefix, style, firstpagenum). Plans are refused, with the
reason, wherever the evidence is missing or allows two answers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import roman

RANGE = "struct<startpage:int,prefix:string,style:string,firstpagenum:int>"


def preflight(labels_broken: Column, verified: Column, offset: Column, offset_share: Column) -> Column:
    """Struct (suspicion, ok). Broken labels: repairable with three proven folios, else unpaginated, both rejected; else an
    offset (one difference for 80 %, not 0) or unclear (no such difference) is let through, like healthy."""
    named = (
        F.when(labels_broken & (verified >= 3), "repairable").when(labels_broken, "unpaginated")
        .when((offset_share >= 0.8) & (offset != 0), "offset").when(offset.isNotNull() & (offset_share < 0.8), "unclear").otherwise("healthy")
    )
    return F.struct(named.alias("suspicion"), (~named.isin("repairable", "unpaginated")).alias("ok"))


def segments(points: DataFrame) -> DataFrame:
    """(doc, first_page, value) of the one or two runs of equal values over pages; documents with more runs are left out."""
    by_page = W.partitionBy("doc").orderBy("page")
    starts = points.withColumn("before", F.lag("value").over(by_page)).filter(F.col("before").isNull() | (F.col("before") != F.col("value")))
    return starts.withColumn("n", F.count("*").over(W.partitionBy("doc"))).filter("n <= 2").select("doc", F.col("page").alias("first_page"), "value")


def boundaries(folio: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, page): pages in (lo, hi] whose printed number is 1 + jump more than the page's before. ``spans``: doc, lo, hi, jump."""
    by_page = W.partitionBy("doc").orderBy("page")
    steps = folio.select("doc", "page", (F.col("page") - F.lag("page").over(by_page)).alias("gap"), (F.col("value") - F.lag("value").over(by_page)).alias("rise")).filter("gap = 1")
    return steps.join(spans, "doc").filter((F.col("page") > F.col("lo")) & (F.col("page") <= F.col("hi")) & (F.col("rise") == 1 + F.col("jump"))).select("doc", "page")


def offset_classes(anchors: DataFrame) -> DataFrame:
    """(doc, class): what relates labels to truth. ``anchors``: doc, page, label, truth (texts).

    With numeric labels on all numeric truths: reprint-start (labels count physical pages) or constant-offset for one
    difference, two-range for two in order. Without: injection, if truth minus page has one or two such values.
    """
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("int"))
    known = anchors.select("doc", "page", number("label").alias("n"), number("truth").alias("m")).filter("m IS NOT NULL")
    facts = known.groupBy("doc").agg(F.count("*").alias("all"), F.count("n").alias("labelled"), F.min(F.coalesce(F.col("n") == F.col("page") + 1, F.lit(False))).alias("identity"))
    runs = lambda value: segments(known.select("doc", "page", value.alias("value")).filter("value IS NOT NULL")).groupBy("doc").agg(F.count("*").alias("runs"))
    joined = facts.join(runs(F.col("m") - F.col("n")).withColumnRenamed("runs", "by_label"), "doc", "left").join(runs(F.col("m") - F.col("page")).withColumnRenamed("runs", "by_page"), "doc", "left")
    labelled = F.col("labelled") == F.col("all")
    kind = (
        F.when(F.col("all") < 2, "unclassifiable")
        .when(labelled & (F.col("by_label") == 1), F.when(F.col("identity"), "reprint-start").otherwise("constant-offset"))
        .when(labelled & (F.col("by_label") == 2), "two-range")
        .when(~labelled & F.col("by_page").isNotNull(), "injection")
        .otherwise("unclassifiable")
    )
    return joined.select("doc", kind.alias("class"))


def label_of(spec: Column, page: Column) -> Column:
    """The label that a spec gives a page: of the last range that starts by then; none before the first."""
    ranges = F.filter(F.array_sort(spec), lambda r: r["startpage"] <= page)
    last = F.element_at(ranges, -1)
    n = F.coalesce(last["firstpagenum"], F.lit(1)) + page - last["startpage"]
    core = F.when(last["style"] == "r", roman(n)).when(last["style"] == "R", F.upper(roman(n))).otherwise(n.cast("string"))
    return F.when(F.size(ranges) == 0, "").otherwise(F.concat(F.coalesce(last["prefix"], F.lit("")), core))


def expected_labels(specs: DataFrame) -> DataFrame:
    """(doc, page, label) for every page; ``specs``: doc, page_count, spec."""
    pages = specs.filter("page_count > 0").select("doc", "spec", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    return pages.select("doc", "page", label_of(F.col("spec"), F.col("page")).alias("label"))


def plans(books: DataFrame) -> DataFrame:
    """(doc, spec, refused) of each book: doc, class, spec, anchors (page, n, m), folio (page, value).

    constant-offset and reprint-start move the ranges under anchors; two-range needs exactly one page where the printed
    number jumps by the difference; injection counts from the first anchor, and pages before it keep what they have. A
    book is one row, so its evidence is bounded by its pages.
    """

    def in_effect(spec: list[dict], page: int) -> int | None:
        return max((k for k, r in enumerate(spec) if r["startpage"] <= page), default=None, key=lambda k: spec[k]["startpage"])

    def shifted(spec: list[dict], pages: list[int], by: int) -> list[dict]:
        touched = {in_effect(spec, p) for p in pages}
        return [{**r, "firstpagenum": (r["firstpagenum"] or 1) + by} if k in touched else dict(r) for k, r in enumerate(spec)]

    def plan(kind: str, spec: list[dict], anchors: list[dict], folio: dict[int, int]) -> tuple[list[dict] | None, str | None]:
        anchors = sorted(anchors, key=lambda a: a["page"])
        if kind in ("constant-offset", "reprint-start"):
            by = anchors[0]["m"] - anchors[0]["n"]
            return (shifted(spec, [a["page"] for a in anchors], by), None) if by else (None, "labels are right already")
        if kind == "two-range":
            steps = [(a["page"], a["m"] - a["n"]) for a in anchors]
            first, second = steps[0], next(s for s in steps if s[1] != steps[0][1])
            if in_effect(spec, first[0]) != in_effect(spec, second[0]):
                return None, "the spec has a range boundary between the anchors"
            jump = second[1] - first[1]
            hits = [q + 1 for q in range(first[0], second[0]) if q in folio and q + 1 in folio and folio[q + 1] - folio[q] == 1 + jump]
            if len(hits) != 1:
                return None, f"{len(hits)} places where printed numbers jump by {jump}"
            out = shifted(spec, [p for p, _ in steps if p < hits[0]], first[1])
            base = out[in_effect(out, first[0])]
            truth = next(a for a in anchors if a["page"] >= hits[0])
            added = {"startpage": hits[0], "prefix": base["prefix"], "style": base["style"], "firstpagenum": truth["m"] - (truth["page"] - hits[0])}
            return sorted([*out, added], key=lambda r: r["startpage"]), None
        if kind == "injection":
            start, value = anchors[0]["page"], anchors[0]["m"]
            while start - 1 in folio and folio[start - 1] == value - 1:
                start, value = start - 1, value - 1
            front = [dict(r) for r in spec if r["startpage"] < start] or ([{"startpage": 0, "prefix": "", "style": "r", "firstpagenum": 1}] if start else [])
            return [*front, {"startpage": start, "prefix": "", "style": "D", "firstpagenum": value}], None
        return None, "unclassifiable"

    def run(frames):
        for frame in frames:
            rows = []
            for b in frame.itertuples(index=False):
                as_dicts = [[dict(x.asDict() if hasattr(x, "asDict") else x) for x in (y if y is not None else [])] for y in (b.spec, b.anchors, b.folio)]
                rows.append((b.doc, *plan(b.kind, as_dicts[0], as_dicts[1], {f["page"]: f["value"] for f in as_dicts[2]})))
            yield pd.DataFrame(rows, columns=["doc", "spec", "refused"])

    kind = dict(books.dtypes)["doc"]
    return books.select("doc", F.col("class").alias("kind"), "spec", "anchors", "folio").mapInPandas(run, f"doc {kind}, spec array<{RANGE}>, refused string")


def retrust(chunks: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks whose locator should change or be confirmed: (chunk_id, decision, page_source, label_start, label_end).

    chunks: chunk_id, doc, type, first_page, last_page, label_start, label_end; pages: doc, page, label, source; books: doc,
    evidenced, skip. EPUB pointers have no pages; held books and folio claims without evidence stay as they are; a verified
    first page takes the printed label, and an end page that isn't verified loses its own.
    """
    at = lambda side, end: pages.select("doc", F.col("page").alias(end), F.col("label").alias(f"{side}_label"), F.col("source").alias(f"{side}_source"))
    joined = chunks.join(books, "doc", "left").join(at("a", "first_page"), ["doc", "first_page"], "left").join(at("z", "last_page"), ["doc", "last_page"], "left")
    source = F.when(F.col("type") == "epub_cfi", "none").otherwise(F.coalesce("a_source", F.lit("physical_only")))
    folio = (F.col("type") == "page_span") & (source == "folio_verified")
    held = F.when((F.col("type") != "epub_cfi") & F.coalesce("skip", F.lit(False)), "skip_book").when(folio & ~F.coalesce("evidenced", F.lit(False)), "no_evidence_folio")
    start = F.when(folio, F.coalesce("a_label", "label_start")).otherwise(F.col("label_start"))
    end = F.when(folio & F.col("last_page").isNotNull(), F.when(F.col("z_source") == "folio_verified", F.coalesce("z_label", "a_label"))).otherwise(F.col("label_end"))
    decision = F.coalesce(held, F.when(start.eqNullSafe(F.col("label_start")) & end.eqNullSafe(F.col("label_end")), "stamp").otherwise("heal"))
    kept = held.isNotNull()
    return joined.filter(F.col("type").isin("epub_cfi", "page_span")).select("chunk_id", decision.alias("decision"), F.when(~kept, source).alias("page_source"), F.when(kept, F.col("label_start")).otherwise(start).alias("label_start"), F.when(kept, F.col("label_end")).otherwise(end).alias("label_end"))


def plan_check(plan: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc, page, label, folio, reason) of plan rows that can't stand. ``plan``: doc, page (text, counts from 1), label;
    ``verified``: doc, page (from 0), value. A page that isn't a number or wasn't verified is a fault, not a pass."""
    number = F.when(F.trim("page").rlike("^[+-]?[0-9]{1,9}$"), F.trim("page").cast("int"))
    proven = verified.select("doc", (F.col("page") + 1).cast("int").alias("_at"), F.trim(F.col("value").cast("string")).alias("folio"))
    joined = plan.withColumn("_at", number).join(proven, ["doc", "_at"], "left")
    reason = F.when(F.col("_at").isNull(), "not a page number").when(F.col("folio").isNull(), "page not verified").when(F.trim("label") != F.col("folio"), "contradicts folio")
    return joined.select("doc", "page", "label", "folio", reason.alias("reason")).filter("reason IS NOT NULL")
