"""Label repair and anchors over the test tables: conversations are books, turns are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import anchors, repair, trust
from lectern.plans.library_queries import _RUNS, _candidates
from lectern.plans.registry import LINES, lines, query, table


@query("""WITH p AS (SELECT conv_id AS doc, turn AS page, length(text) % 2 AS value FROM conversations), s AS (SELECT *, lag(value) OVER (PARTITION BY doc ORDER BY page) AS b FROM p),
t AS (SELECT doc, page AS first_page, value FROM s WHERE b IS NULL OR b <> value) SELECT doc, first_page, value FROM t QUALIFY count(*) OVER (PARTITION BY doc) <= 2""")
def segment_fit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return repair.segments(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (F.length("text") % 2).cast("long").alias("value")))


@query("""WITH c AS (SELECT conv_id AS doc, turn AS page, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE turn + 10 + CASE WHEN length(text) % 11 = 0 THEN 1 ELSE 0 END END AS value FROM conversations),
n AS (SELECT * FROM c WHERE value IS NOT NULL), s AS (SELECT doc, page, page - lag(page) OVER w AS gap, value - lag(value) OVER w AS rise FROM n WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, page FROM s WHERE gap = 1 AND rise = 2 AND page > 0 AND page <= 50""")
def boundary_pins(spark, sf_dir):
    folio = _candidates(spark, sf_dir).filter("value IS NOT NULL")
    spans = folio.select("doc").distinct().select("doc", F.lit(0).alias("lo"), F.lit(50).alias("hi"), F.lit(1).alias("jump"))
    return repair.boundaries(folio, spans)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size > 20 THEN 'repairable' WHEN p_size % 2 = 0 THEN 'unpaginated' WHEN p_size % 3 = 0 THEN 'offset' WHEN p_size % 3 = 1 THEN 'unclear' ELSE 'healthy' END AS suspicion, p_size % 2 <> 0 AS ok FROM part""")
def preflight(spark, sf_dir):
    n = F.col("p_size")
    verdict = repair.preflight(n % 2 == 0, F.when(n > 20, 5).otherwise(1), F.when(n % 3 == 2, 0).otherwise(2), F.when(n % 3 == 1, 0.4).otherwise(0.9))
    return table(spark, sf_dir, "part").select("p_partkey", verdict.alias("v")).select("p_partkey", "v.suspicion", "v.ok")


@query(f"""WITH {_RUNS}, p AS (SELECT doc, page, value::VARCHAR AS label FROM r), k AS (SELECT conv_id || ':' || turn AS chunk_id, conv_id AS doc, turn AS first_page, turn + 1 AS last_page, turn::VARCHAR AS ls, (turn + 1)::VARCHAR AS le FROM conversations),
j AS (SELECT k.*, a.label AS al, z.label AS zl, a.doc IS NOT NULL AS folio FROM k LEFT JOIN p a ON a.doc = k.doc AND a.page = first_page LEFT JOIN p z ON z.doc = k.doc AND z.page = last_page)
SELECT chunk_id, CASE WHEN doc % 5 = 0 THEN 'skip_book' WHEN folio AND doc % 3 = 0 THEN 'no_evidence_folio' WHEN folio AND (al <> ls OR zl IS NULL OR zl <> le) THEN 'heal' ELSE 'stamp' END AS decision,
CASE WHEN doc % 5 = 0 OR (folio AND doc % 3 = 0) THEN NULL WHEN folio THEN 'folio_verified' ELSE 'physical_only' END AS page_source,
CASE WHEN doc % 5 = 0 OR doc % 3 = 0 OR NOT folio THEN ls ELSE al END AS label_start, CASE WHEN doc % 5 = 0 OR doc % 3 = 0 OR NOT folio THEN le ELSE zl END AS label_end FROM j""")
def retrust_plan(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    chunks = c.select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc"), F.lit("page_span").alias("type"), F.col("turn").alias("first_page"), (F.col("turn") + 1).alias("last_page"), F.col("turn").cast("string").alias("label_start"), (F.col("turn") + 1).cast("string").alias("label_end"))
    pages = trust.folio_runs(_candidates(spark, sf_dir)).select("doc", "page", F.col("value").cast("string").alias("label"), F.lit("folio_verified").alias("source"))
    books = c.select(F.col("conv_id").alias("doc")).distinct().select("doc", (F.col("doc") % 3 != 0).alias("evidenced"), (F.col("doc") % 5 == 0).alias("skip"))
    return repair.retrust(chunks, pages, books)


@query(f"""WITH {LINES}, b AS (SELECT doc_id, chunk_index, chunk_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[*_`#>]+', '', 'g'), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS t FROM lines),
e AS (SELECT * FROM b WHERE length(t) >= 12), p AS (SELECT c.chunk_id, e.chunk_index AS seq, contains(c.t, left(e.t, 40)) OR (length(c.t) >= 20 AND contains(e.t, left(c.t, 40))) AS a, contains(c.t, right(e.t, 40)) OR (length(c.t) >= 20 AND contains(e.t, right(c.t, 40))) AS z FROM b c JOIN e USING (doc_id)),
f AS (SELECT chunk_id, min(seq) FILTER (a) AS a, max(seq) FILTER (z) AS z FROM p GROUP BY chunk_id)
SELECT b.chunk_id, coalesce(a, 0)::VARCHAR AS cfi_start, CASE WHEN a <= z THEN z ELSE coalesce(a, 0) END::VARCHAR AS cfi_end FROM b LEFT JOIN f USING (chunk_id)""")
def cfi_pointers(spark, sf_dir):
    rows = lines(spark, sf_dir)
    entries = rows.select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("seq"), F.col("chunk_index").cast("string").alias("cfi"), "text")
    return anchors.pointers(rows.select("chunk_id", F.col("doc_id").alias("doc"), "text"), entries)


@query("""WITH RECURSIVE t AS (SELECT p_partkey, p_size, p_brand FROM part) SELECT p_partkey, unnest(range(0, 4))::INT AS page, unnest(CASE WHEN p_size % 2 = 0 THEN ['', 'A' || p_size, 'A' || (p_size + 1), '7'] ELSE ['', 'i', 'ii', '7'] END) AS label FROM t""")
def label_expansion(spark, sf_dir):
    r = lambda start, prefix, style, first: F.struct(F.lit(start).alias("startpage"), F.lit(prefix).alias("prefix"), F.lit(style).alias("style"), first.cast("int").alias("firstpagenum"))
    n = F.col("p_size")
    spec = F.when(n % 2 == 0, F.array(r(1, "A", "D", n), r(3, "", "D", F.lit(7)))).otherwise(F.array(r(1, "", "r", F.lit(1)), r(3, "", "D", F.lit(7))))
    books = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(4).alias("page_count"), spec.alias("spec"))
    return repair.expected_labels(books).select(F.col("doc").alias("p_partkey"), "page", "label")
