"""Page trust: how far printed page numbers, labels and plans can be believed. Pages count from 0; ``doc`` groups them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_RUN = 3
STRENGTH = {"bare": 0, "eli": 1, "lseries": 1, "lead": 2, "trail": 2, "mid": 3, "roman": 4, "weak": 5}
#: What a line in a page's top or bottom band may look like.
NUMBER = "(?<![0-9./(])([0-9]{1,4})(?![0-9./)])"
SERIES = "\\bL\\s*[0-9]{1,4}\\s*/\\s*([0-9]{1,4})\\b"
PART_OF = "(?:^|\\s)([0-9]{1,4})/[0-9]{1,4}(?:\\s|$)"
YEARS = (1900, 2030)
LONGEST_HEAD = 90
SOFT = ("lead", "mid", "trail", "weak")


def label_sanity(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, trust): pdf_label_sane or physical_only. ``labels``: doc, page, label; ``pages``: doc, page_count.

    Labels must be 80 % unique, their numbers must hardly fall (if 80 % have one), and they must cover half of the pages.
    """
    n = F.regexp_extract("label", "([0-9]{1,4})", 1)
    numbered = labels.withColumn("n", F.when(n != "", n.cast("int")))
    before = F.last("n", ignorenulls=True).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    facts = numbered.withColumn("drop", F.col("n") < before).groupBy("doc").agg(F.count("*").alias("all"), F.countDistinct("label").alias("uniq"), F.count("n").alias("nums"), F.count_if("drop").alias("drops"))
    joined = pages.join(facts, "doc", "left")
    falls = (F.col("nums") >= F.col("all") * 0.8) & (F.col("nums") > 1) & (F.col("drops") > F.greatest(F.lit(1), F.floor(F.col("nums") / 50)))
    bad = F.col("all").isNull() | (F.col("page_count") == 0) | (F.col("uniq") < F.col("all") * 0.8) | falls | (F.col("all") < F.col("page_count") * 0.5)
    return joined.select("doc", F.when(bad, "physical_only").otherwise("pdf_label_sane").alias("trust"))


def folio_runs(candidates: DataFrame) -> DataFrame:
    """(doc, run, page, value) of pages in runs of at least three pages on end whose numbers go up by one."""
    by_page = W.partitionBy("doc").orderBy("page")
    numbers = candidates.filter("value IS NOT NULL")
    breaks = (F.col("page") != F.lag("page").over(by_page) + 1) | (F.col("value") != F.lag("value").over(by_page) + 1)
    runs = numbers.withColumn("brk", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("run", F.sum("brk").over(by_page))
    return runs.withColumn("n", F.count("*").over(W.partitionBy("doc", "run"))).filter(F.col("n") >= LEAST_RUN).select("doc", "run", "page", "value", "n")


def verified_folios(candidates: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(doc, page, value): members of runs; where runs claim the same number the longest wins, and a tie leaves it nowhere.

    ``chapters``: doc, start, ordinal; then numbers clash within a chapter only (that of the run's first page).
    """
    runs = folio_runs(candidates)
    if chapters is None:
        keyed = runs.withColumn("chapter", F.lit(0))
    else:
        heads = runs.groupBy("doc", "run").agg(F.min("page").alias("first"))
        of = heads.join(chapters, "doc").filter("start <= first").groupBy("doc", "run").agg(F.max_by("ordinal", "start").alias("chapter"))
        keyed = runs.join(of, ["doc", "run"], "left").withColumn("chapter", F.coalesce("chapter", F.lit(0)))
    claim = W.partitionBy("doc", "chapter", "value")
    best = keyed.withColumn("most", F.max("n").over(claim)).withColumn("same", F.count_if(F.col("n") == F.col("most")).over(claim))
    return best.filter("n = most AND same = 1").select("doc", "page", "value")


def offset_relation(labels: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc, relation, offset, samples): identity, shift (one offset for 90 %) or divergent; documents without pairs are left out.

    Ties between offsets go to the one that fewer pages come before, then to the smaller.
    """
    pairs = verified.select("doc", "page", F.col("value").alias("folio")).join(labels, ["doc", "page"]).filter(F.col("label").rlike("^[0-9]+$"))
    counts = pairs.groupBy("doc", (F.col("folio") - F.col("label").cast("int")).alias("offset")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    per = counts.groupBy("doc").agg(F.sum("n").alias("samples"), F.min(F.struct((-F.col("n")).alias("n"), "first", "offset")).alias("top"))
    sure = -F.col("top.n") >= F.col("samples") * 0.9
    relation = F.when(sure & (F.col("top.offset") == 0), "identity").when(sure, "shift").otherwise("divergent")
    return per.select("doc", relation.alias("relation"), F.when(sure, F.col("top.offset")).alias("offset"), "samples")


def drop_constants(harvest: DataFrame, pages: DataFrame) -> DataFrame:
    """``harvest`` (doc, page, form, value, zone, seq) less soft numbers that stand on a third of the pages (two at least; books of 4 pages on)."""
    seen = harvest.filter(F.col("form").isin(*SOFT)).groupBy("doc", "value").agg(F.count("*").alias("n"))
    constant = seen.join(pages, "doc").filter((F.col("page_count") >= 4) & (F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("page_count") + 2) / 3)))).select("doc", "value")
    soft = harvest.filter(F.col("form").isin(*SOFT)).join(constant, ["doc", "value"], "left_anti")
    return soft.select(*harvest.columns).unionByName(harvest.filter(~F.col("form").isin(*SOFT)))


def pick_candidates(harvest: DataFrame) -> DataFrame:
    """(doc, page, value): a page's candidate that continues the last strong pick of the page before, else the strongest, top first.

    A pick depends on the one before, so a document's pages go through one function in order; a book bounds the group.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page", "seq"])
        strong, out = None, []
        for page, rows in frame.groupby("page", sort=True):
            wanted = strong[1] + 1 if strong and strong[0] == page - 1 else None
            order = [(0 if wanted is not None and r.value.isdigit() and int(r.value) == wanted else 1, STRENGTH.get(r.form, 9), r.zone != "top", k) for k, r in enumerate(rows.itertuples())]
            best = rows.iloc[min(order)[-1]]
            out.append((best["doc"], page, best["value"]))
            if best["form"] in ("bare", "eli", "lseries"):
                strong = (page, int(best["value"])) if best["value"].isdigit() else None
        return pd.DataFrame(out, columns=["doc", "page", "value"])

    return harvest.groupBy("doc").applyInPandas(pick, f"doc {dict(harvest.dtypes)['doc']}, page {dict(harvest.dtypes)['page']}, value string")


def harvest_lines(lines: DataFrame) -> DataFrame:
    """Number candidates of page-band lines (doc, page, zone, seq, line): (doc, page, form, value, zone, seq)."""
    line = F.regexp_replace("line", "^\\s+|\\s+$", "")
    number = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(1))
    year = lambda v: v.cast("int").between(*YEARS)
    cell = lambda form, value: F.array(F.struct(form.alias("form"), value.alias("value")))
    many = lambda: F.transform(F.col("numbers"), lambda v, i: F.struct(F.when(year(v), "weak").when(F.col("line").startswith(v), F.when(v == F.col("numbers")[0], "lead").otherwise("mid")).when(F.col("line").endswith(v), F.when(v == F.element_at("numbers", -1), "trail").otherwise("mid")).otherwise("mid").alias("form"), v.alias("value")))
    roman_tail = F.regexp_extract("line", "(?i)\\s([ivxlcdm]{1,7})$", 1)
    series = F.regexp_extract("line", SERIES, 1)
    part_of = F.regexp_extract("line", PART_OF, 1)
    sound = lambda v: (v != "") & ~v.rlike("^0.")
    none = F.array().cast("array<struct<form:string,value:string>>")
    base = lines.withColumn("line", line).withColumn("numbers", number)
    found = (
        F.when(F.col("line") == "", none)
        .when(F.col("line").rlike("^[0-9]{1,4}$"), cell(F.when(year(F.col("line")), "weak").otherwise("bare"), F.col("line")))
        .when(F.col("line").rlike("(?i)^[ivxlcdm]{1,7}$"), cell(F.lit("roman"), F.lower("line")))
        .when(F.length("line") > LONGEST_HEAD, none)
        .when(series != "", cell(F.lit("lseries"), series))
        .when(sound(part_of) & (F.col("line").rlike("^[0-9]+/[0-9]+$") | F.lower("line").contains("eli")), cell(F.lit("eli"), part_of))
        .when((roman_tail != "") & F.col("line").rlike("\\S\\s+\\S"), cell(F.lit("roman"), F.lower(roman_tail)))
        .when((F.size("numbers") >= 2) & (F.length(F.regexp_replace("line", "[\\d\\s.,/–-]", "")) < 4), none)
        .when(F.col("line").rlike("[.!;:]$"), none)
        .otherwise(many())
    )
    return base.select("doc", "page", "zone", "seq", F.posexplode(found).alias("k", "c")).select("doc", "page", "c.form", "c.value", "zone", (F.col("seq") * 100 + F.col("k")).alias("seq"))


def label_in_effect(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pages`` (doc, page) with the label of the last range (doc, start, label) that began by then."""
    marks = pages.select("doc", "page", F.lit(None).cast("string").alias("label"), F.lit(1).alias("is_page")).unionByName(ranges.select("doc", F.col("start").alias("page"), "label", F.lit(0).alias("is_page")))
    last = F.last("label", ignorenulls=True).over(W.partitionBy("doc").orderBy("page", "is_page").rowsBetween(W.unboundedPreceding, 0))
    return marks.withColumn("label", last).filter("is_page = 1").drop("is_page")


def plan_coverage(plan: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc, covered, contradictions, outside): verified pages in a plan section (from_page..to_page, start_label) and their labels."""
    joined = verified.alias("v").join(plan.alias("p"), (F.col("v.doc") == F.col("p.doc")) & F.col("v.page").between(F.col("p.from_page"), F.col("p.to_page")), "left")
    told = F.col("p.start_label") + F.col("v.page") - F.col("p.from_page")
    return joined.groupBy(F.col("v.doc").alias("doc")).agg(F.count("p.doc").alias("covered"), F.count_if(told != F.col("v.value")).alias("contradictions"), F.count_if(F.col("p.doc").isNull()).alias("outside"))


def _batch_step(bytes_: Column, pages: Column, budget: int) -> Column:
    per_page = F.greatest(F.lit(1), F.floor(bytes_ / F.greatest(pages, F.lit(1))))
    return F.greatest(F.lit(1), F.floor(F.lit(budget) / per_page)).cast("int")


def batch_starts(bytes_: Column, pages: Column, budget: int) -> Column:
    """The first pages of ``scan_batches``, as long."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(pages - 1, F.lit(0)).cast("long"), _batch_step(bytes_, pages, budget).cast("long"))
    return F.when(pages > 0, starts).otherwise(F.array().cast("array<bigint>"))


def scan_batches(bytes_: Column, pages: Column, budget: int) -> Column:
    """[start, end) page intervals of which each decodes to about ``budget`` bytes."""
    step, starts = _batch_step(bytes_, pages, budget), batch_starts(bytes_, pages, budget)
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s.cast("int") + step, pages.cast("int")).alias("end")))


def is_raster_scan(pages: Column, chars: Column, raster_pages: Column, bytes_: Column) -> Column:
    """Eight pages on, under 20 characters a page, 80 % of pages one image, over 1.5e9 decoded bytes."""
    return (pages >= 8) & (chars / pages < 20) & (raster_pages / pages >= 0.8) & (bytes_ > 1_500_000_000)


def trust_level(folio: Column, label: Column, sane: Column) -> Column:
    """Struct (label, source) by priority: verified folio, sane label, else the physical page only."""
    return F.when(folio.isNotNull(), F.struct(folio.cast("string").alias("label"), F.lit("folio_verified").alias("source"))).when(sane & label.isNotNull(), F.struct(label.alias("label"), F.lit("pdf_label_sane").alias("source"))).otherwise(F.struct(F.lit(None).cast("string").alias("label"), F.lit("physical_only").alias("source")))


def chapter_restarts(sections: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, start, ordinal) of the chapters of books that count pages by chapter: all or nothing a book.

    ``sections``: doc, start, value (the first number) of label sections in plain numbers; ``candidates``: doc, page, value. A book counts by
    chapter if it has two sections, at least one run of printed numbers lies within a section and has its numbers, and none contradicts:
    by other numbers, by crossing into the next section, or by leading from the front matter into the first. Runs before the first
    section say nothing. Books without a verdict are left out, and their numbers count through the book.
    """
    runs = folio_runs(candidates).groupBy("doc", "run").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.min_by("value", "page").alias("told"))
    trees = sections.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("tree")).filter(F.size("tree") >= 2)
    begun = F.size(F.filter("tree", lambda s: s["start"] <= F.col("first")))
    own, following = F.get(F.col("tree"), begun - 1), F.get(F.col("tree"), begun)
    crosses = F.coalesce(F.col("last") >= following["start"], F.lit(False))
    wrong = crosses | ((begun > 0) & (F.col("told") != own["value"] + F.col("first") - own["start"]))
    judged = runs.join(trees, "doc").select("doc", "tree", wrong.alias("wrong"), ((begun > 0) & ~wrong).alias("right"))
    sure = judged.groupBy("doc").agg(F.bool_or("wrong").alias("wrong"), F.bool_or("right").alias("right"), F.first("tree").alias("tree")).filter("right AND NOT wrong")
    return sure.select("doc", F.posexplode("tree").alias("at", "s")).select("doc", "s.start", (F.col("at") + 1).alias("ordinal"))


def build_page_trust(pages: DataFrame, labels: DataFrame, candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, page, label, source, chapter) of every page. ``pages``: doc, page, has_text; ``labels``: doc, page, label, tier; the others as in ``chapter_restarts``.

    A verified printed number comes first, then a label, if the book's labels are sane and more than half of its pages have one of
    the publisher (tier 1), else the physical page, counted from 1. Pages without text and number are blind. ``chapter`` is
    null before the first chapter and in books that don't count by chapter.
    """
    counts = pages.groupBy("doc").agg(F.count("*").alias("page_count"))
    published = labels.groupBy("doc").agg(F.count_if((F.col("tier") == 1) & (F.trim("label") != "")).alias("published"))
    enough = counts.join(published, "doc").filter(F.col("published") * 2 > F.col("page_count")).select("doc")
    sane = label_sanity(labels.select("doc", "page", "label"), counts).filter("trust = 'pdf_label_sane'").join(enough, "doc", "left_semi").select("doc", F.lit(True).alias("sane"))
    chapters = chapter_restarts(sections, candidates)
    folio = verified_folios(candidates, chapters).select("doc", "page", F.col("value").alias("folio"))
    starts = chapters.groupBy("doc").agg(F.collect_list("start").alias("starts"))
    met = pages.join(folio, ["doc", "page"], "left").join(labels.select("doc", "page", F.col("label").alias("told")), ["doc", "page"], "left").join(sane, "doc", "left").join(starts, "doc", "left")
    physical = (F.col("page") + 1).cast("string")
    source = F.when(F.col("folio").isNotNull(), "folio_verified").when(~F.col("has_text"), "blind").when(F.col("sane") & F.col("told").isNotNull(), "pdf_label_sane").otherwise("physical_only")
    label = F.when(F.col("folio").isNotNull(), F.col("folio").cast("string")).when(source == "pdf_label_sane", F.col("told")).otherwise(physical)
    chapter = F.nullif(F.size(F.filter("starts", lambda s: s <= F.col("page"))), F.lit(0))
    return met.select("doc", "page", label.alias("label"), source.alias("source"), chapter.alias("chapter"))
