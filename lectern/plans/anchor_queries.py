"""Quotes and anchors over the test tables: documents are books, their lines are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import anchors, quotes, trust
from lectern.plans.registry import LINES, lines, query, table



def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _bare(c: str) -> str:
    return f"lower(regexp_replace(replace(replace(replace({c}, 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _forms(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '[\\x20\\x09-\\x0D]+'), lambda x: {_bare('x')}), lambda x: x <> '')"


_STEPS = [(f"w[{a + 1}:{b}]" if a >= 0 else f"w[len(w) + {a + 1}:len(w) + {b or 0}]", n) for a, b, n in quotes.LADDER]


def _altered(spark, sf_dir):
    """A quote of the longest line of each document, altered in one of six ways by id, and the lines; one way runs the lines' words together."""
    pages = lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("page"), F.when(F.col("doc_id") % 6 == 5, F.replace("text", F.lit(" "), F.lit("\x02"))).otherwise(F.col("text")).alias("text"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    own = F.array_min(F.transform(F.split("text", "\n"), lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("chunk_index"), x.alias("text"))))
    longest = docs.groupBy("doc_id").agg(F.min(own).alias("top"))
    w = F.slice(F.filter(F.split("top.text", quotes.SPACES), lambda x: x != ""), 2, 24)
    way = F.col("doc_id") % 6
    third = F.get(F.col("w"), F.lit(2))
    dashed = F.transform("w", lambda x, i: F.when(i == 2, F.concat(F.substring(third, 1, 2), F.lit("-"), F.substring(third, 3, 1000))).otherwise(x))
    quote = (
        F.when(way == 1, F.array_join(F.concat(F.slice("w", 1, 5), F.slice("w", 7, 24)), " ")).when(way == 2, F.array_join(dashed, " "))
        .when(way == 3, F.array_join("w", "\n")).when(way == 4, F.replace(F.array_join("w", " "), F.lit("e"), F.lit("E"))).otherwise(F.array_join("w", " "))
    )
    made = longest.select("doc_id", w.alias("w")).select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("doc"), quote.alias("quote"), F.lit(None).cast("int").alias("hint"))
    return made, pages


@query(f"""WITH {LINES}, pages AS (SELECT doc_id AS doc, chunk_index AS page, CASE WHEN doc_id % 6 = 5 THEN replace(text, ' ', chr(2)) ELSE text END AS text FROM lines),
top AS (SELECT doc_id, text FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_index) = 1),
q0 AS (SELECT doc_id, ({_words('text')})[2:25] AS w FROM top),
q1 AS (SELECT doc_id AS doc, CASE doc_id % 6 WHEN 1 THEN array_to_string(w[1:5] || w[7:30], ' ')
  WHEN 2 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 3 THEN x[1:2] || '-' || x[3:] ELSE x END), ' ')
  WHEN 3 THEN array_to_string(w, chr(10)) WHEN 4 THEN replace(array_to_string(w, ' '), 'e', 'E') ELSE array_to_string(w, ' ') END AS quote FROM q0),
q AS (SELECT doc, {_forms('quote')} AS w FROM q1),
c AS (SELECT doc, list_filter(w, lambda x: length(x) > 3)[1:14] AS core FROM q),
s AS ({' UNION ALL '.join(f"SELECT doc, {k} AS step, array_to_string({cut}, ' ') AS win FROM q WHERE len(w) >= {n}" for k, (cut, n) in enumerate(_STEPS))}),
a AS (SELECT * FROM s WHERE length(win) >= 12),
f AS (SELECT doc, page, text, length(text) AS size, {_forms('text')} AS w FROM pages),
b AS (SELECT doc, page, size, text, array_to_string(w, '') AS body FROM f),
post AS (SELECT DISTINCT doc, page, array_to_string(w[i:i + k - 1], ' ') AS win FROM f, range(1, 5) t(k), unnest(range(1, len(w) - k + 2)) u(i)),
j AS (SELECT a.doc, a.step, b.page, b.size, len(list_filter(core, lambda x: contains(body, x))) AS core, len(core) AS core_all
      FROM a JOIN post p ON p.doc = a.doc AND p.win = a.win JOIN b ON b.doc = a.doc AND b.page = p.page JOIN c ON c.doc = a.doc),
h1 AS (SELECT *, core_all >= 4 AND core >= greatest(4, floor(core_all * 0.7)) AS proven FROM j),
h2 AS (SELECT a.doc, step + 9 AS step, page, size, 0 AS core, 0 AS core_all, false AS proven FROM a JOIN b ON a.doc = b.doc AND contains(body, replace(win, ' ', ''))
       WHERE length(replace(win, ' ', '')) >= 14 AND a.doc NOT IN (SELECT doc FROM j)),
h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2),
n AS (SELECT *, count(*) OVER (PARTITION BY doc, proven, step) AS hits FROM h),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc ORDER BY proven DESC, step, size DESC, page) = 1),
o AS (SELECT r.*, b.text, position(replace(a.win, ' ', '') IN b.body) - 1 AS before FROM r JOIN a ON a.doc = r.doc AND a.step = r.step % 9 JOIN b ON b.doc = r.doc AND b.page = r.page),
z AS (SELECT doc, before, i, sum(length({_bare('text[i]')})) OVER (PARTITION BY doc ORDER BY i) AS told FROM o, unnest(range(1, length(text) + 1)) u(i)),
p AS (SELECT doc, coalesce(max(i) FILTER (told <= before), 0)::INT AS place FROM z GROUP BY doc)
SELECT q.doc AS doc_id, page, step::INT AS step, proven, core::INT AS core, core_all::INT AS core_all, hits, place FROM q LEFT JOIN r USING (doc) LEFT JOIN p USING (doc)""")
def quote_pages(spark, sf_dir):
    """Where the altered quotes stand."""
    return quotes.locate_quotes(*_altered(spark, sf_dir)).withColumnRenamed("quote_id", "doc_id")


def _books(spark, sf_dir):
    """Documents as books of lines: (pages, labels, candidates, sections), by id in six ways of numbering and four of labelling."""
    rows = lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("page"), "text")
    sizes = rows.groupBy("doc").agg(F.floor(F.count("*") / 3).cast("int").alias("third"))
    b = rows.join(sizes, "doc").withColumns({"way": F.col("doc") % 6, "first": F.when(F.col("doc") % 6 == 5, 5).otherwise(1)})
    page, third = F.col("page"), F.col("third")
    by_chapter = F.when(page < third, page + 1).when(page < 2 * third, page - third + F.col("first")).otherwise(page - 2 * third + F.col("first"))
    value = (
        F.when((F.length("text") % 7 == 0) | (F.col("way") == 4), None).when(F.col("way") == 2, page - third + 1)
        .when(F.col("way") == 1, by_chapter + F.when(page >= 2 * third, 1).otherwise(0)).otherwise(by_chapter)
    )
    kind = F.col("doc") % 4
    labels = b.filter((kind != 2) | (page % 2 == 0)).select("doc", "page", F.when(kind == 3, "x").otherwise((page + 3).cast("string")).alias("label"), F.when(kind == 1, 2).otherwise(1).alias("tier"))
    sections = b.filter((F.col("way") != 3) & (third >= 1) & ((page == third) | (page == 2 * third))).select("doc", page.alias("start"), F.col("first").alias("value"))
    return b.select("doc", "page", (F.trim("text") != "").alias("has_text")), labels, b.select("doc", "page", value.alias("value")), sections


@query(f"""WITH {LINES}, b0 AS (SELECT doc_id AS doc, chunk_index AS page, text, (count(*) OVER (PARTITION BY doc_id) // 3)::INT AS third FROM lines),
b AS (SELECT *, CASE WHEN doc % 6 = 5 THEN 5 ELSE 1 END AS first, CASE WHEN page < third THEN page + 1 WHEN page < 2 * third THEN page - third + CASE WHEN doc % 6 = 5 THEN 5 ELSE 1 END ELSE page - 2 * third + CASE WHEN doc % 6 = 5 THEN 5 ELSE 1 END END AS byc FROM b0),
c AS (SELECT doc, page, CASE WHEN length(text) % 7 = 0 OR doc % 6 = 4 THEN NULL WHEN doc % 6 = 2 THEN page - third + 1 WHEN doc % 6 = 1 THEN byc + (page >= 2 * third)::INT ELSE byc END AS value FROM b),
l AS (SELECT doc, page, CASE WHEN doc % 4 = 3 THEN 'x' ELSE (page + 3)::VARCHAR END AS label, CASE WHEN doc % 4 = 1 THEN 2 ELSE 1 END AS tier FROM b WHERE doc % 4 <> 2 OR page % 2 = 0),
s AS (SELECT doc, page AS start, first AS value, row_number() OVER (PARTITION BY doc ORDER BY page) AS ordinal, lead(page) OVER (PARTITION BY doc ORDER BY page) AS nxt, count(*) OVER (PARTITION BY doc) AS n FROM b WHERE doc % 6 <> 3 AND third >= 1 AND page IN (third, 2 * third)),
v AS (SELECT * FROM c WHERE value IS NOT NULL),
k AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND value = lag(value) OVER w + 1 THEN 0 ELSE 1 END AS brk FROM v WINDOW w AS (PARTITION BY doc ORDER BY page)),
g AS (SELECT doc, page, value, sum(brk) OVER (PARTITION BY doc ORDER BY page) AS run FROM k),
r AS (SELECT *, count(*) OVER (PARTITION BY doc, run) AS n FROM g QUALIFY n >= 3),
h AS (SELECT doc, run, min(page) AS first, max(page) AS last, min(value) AS told FROM r GROUP BY doc, run),
j AS (SELECT h.*, o.start, o.value, o.nxt, (SELECT min(start) FROM s WHERE s.doc = h.doc) AS head FROM h LEFT JOIN s o ON o.doc = h.doc AND o.start <= h.first AND (o.nxt IS NULL OR o.nxt > h.first) WHERE h.doc IN (SELECT doc FROM s WHERE n >= 2)),
w AS (SELECT doc, CASE WHEN start IS NULL THEN last >= head ELSE coalesce(last >= nxt, false) OR told <> value + first - start END AS wrong, start IS NOT NULL AS placed FROM j),
ch AS (SELECT doc FROM w GROUP BY doc HAVING NOT bool_or(wrong) AND bool_or(placed)),
z AS (SELECT r.*, coalesce((SELECT max(ordinal) FROM s WHERE s.doc = h.doc AND s.start <= h.first AND s.doc IN (SELECT doc FROM ch)), 0) AS chapter FROM r JOIN h USING (doc, run)),
f AS (SELECT doc, page, value FROM (SELECT *, max(n) OVER (PARTITION BY doc, chapter, value) AS most FROM z) WHERE n = most QUALIFY count(*) OVER (PARTITION BY doc, chapter, value) = 1),
t AS (SELECT b.doc, count(*) AS pages, count(l.label) AS told, count(DISTINCT l.label) AS uniq, count(*) FILTER (l.tier = 1) AS published FROM b LEFT JOIN l ON l.doc = b.doc AND l.page = b.page GROUP BY b.doc),
ok AS (SELECT doc FROM t WHERE uniq >= told * 0.8 AND told >= pages * 0.5 AND told > 0 AND published * 2 > pages)
SELECT b.doc AS doc_id, b.page, CASE WHEN f.value IS NOT NULL THEN f.value::VARCHAR WHEN trim(text) = '' THEN (b.page + 1)::VARCHAR WHEN ok.doc IS NOT NULL AND l.label IS NOT NULL THEN l.label ELSE (b.page + 1)::VARCHAR END AS label,
CASE WHEN f.value IS NOT NULL THEN 'folio_verified' WHEN trim(text) = '' THEN 'blind' WHEN ok.doc IS NOT NULL AND l.label IS NOT NULL THEN 'pdf_label_sane' ELSE 'physical_only' END AS source,
CASE WHEN b.doc IN (SELECT doc FROM ch) THEN nullif((SELECT count(*) FROM s WHERE s.doc = b.doc AND s.start <= b.page), 0) END::INT AS chapter
FROM b LEFT JOIN f ON f.doc = b.doc AND f.page = b.page LEFT JOIN l ON l.doc = b.doc AND l.page = b.page LEFT JOIN ok ON ok.doc = b.doc""")
def page_trust_build(spark, sf_dir):
    """Every line's label and its source, with chapters that the printed numbers confirm."""
    return trust.build_page_trust(*_books(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


_SP = "[\\x20\\x09-\\x0D]+"
_POOL = f"""p AS (SELECT doc_id AS doc, chunk_index AS page, text, doc_id % 3 <> 2 OR chunk_index % 2 = 0 AS prose, {_words('text')} AS w FROM lines),
s0 AS (SELECT doc, page, (i - 1)::INT AS seq, {_words("parts[i] || '.'")} AS w FROM (SELECT doc, page, string_split(text, '. ') AS parts FROM p) d, unnest(range(1, len(parts) + 1)) u(i)),
s1 AS (SELECT doc, page, seq, w, array_to_string(w, ' ') AS text, len(w) AS n FROM s0 WHERE len(w) BETWEEN 6 AND 45),
s2 AS (SELECT * FROM s1 WHERE NOT regexp_matches(text, '{anchors.BOILERPLATE}') AND NOT regexp_matches(text, '{anchors.ABBREVIATION_END}')),
g AS (SELECT DISTINCT doc, page, array_to_string(w[i:i + 3], ' ') AS h FROM p, unnest(range(1, len(w) - 2)) u(i)),
gp AS (SELECT doc, h, count(*) AS pages FROM g GROUP BY doc, h),
pr AS (SELECT doc, page, seq, array_to_string(w[2:5], ' ') AS h FROM s2 UNION ALL SELECT doc, page, seq, array_to_string(w[3:6], ' ') FROM s2),
ok AS (SELECT pr.doc, page, seq FROM pr JOIN gp ON gp.doc = pr.doc AND gp.h = pr.h GROUP BY pr.doc, page, seq HAVING max(pages) = 1),
b0 AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS k, count(*) OVER (PARTITION BY doc) AS n FROM p WHERE prose AND length(array_to_string(w, ' ')) >= 100),
b AS (SELECT doc, page, CASE WHEN k < n // 3 THEN 0 WHEN k < 2 * n // 3 THEN 1 ELSE 2 END AS third FROM b0 WHERE n >= 4),
pool AS (SELECT s2.doc, s2.page, s2.seq, s2.text, s2.n AS words, third,
         s2.n >= 8 AND regexp_matches(s2.text, '{anchors.SENTENCE_START}') AND NOT regexp_matches(s2.text, '[0-9]{{3,}}') AND list_max(list_transform(s2.w, lambda x: length(x))) >= 8 AND s2.doc % 4 <> 1 AS strict
         FROM s2 JOIN ok USING (doc, page, seq) JOIN p ON p.doc = s2.doc AND p.page = s2.page JOIN b ON b.doc = s2.doc AND b.page = s2.page
         WHERE length(array_to_string(p.w, ' ')) - length(replace(array_to_string(p.w, ' '), s2.text, '')) = length(s2.text))"""


def _position(at: int, used: str) -> str:
    return f"""a{at} AS (SELECT *, bool_or(strict) OVER (PARTITION BY doc) AS have FROM pool {used}),
r{at} AS (SELECT doc, '{anchors.POSITIONS[at]}' AS position, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN have THEN (third <> {at})::INT ELSE 0 END, CASE WHEN have THEN page END, words DESC, third <> {at}, page, seq)::INT AS rank, page, seq, text, NOT have AS relaxed
         FROM a{at} WHERE strict OR NOT have)"""


@query(f"""WITH {LINES}, {_POOL}, {_position(0, '')},
{_position(1, 'WHERE (doc, page) NOT IN (SELECT doc, page FROM r0 WHERE rank = 1)')},
{_position(2, 'WHERE (doc, page) NOT IN (SELECT doc, page FROM r0 WHERE rank = 1 UNION ALL SELECT doc, page FROM r1 WHERE rank = 1)')}
SELECT doc AS doc_id, position, rank, page, seq, text, relaxed FROM r0 UNION ALL SELECT doc, position, rank, page, seq, text, relaxed FROM r1 UNION ALL SELECT doc, position, rank, page, seq, text, relaxed FROM r2""")
def anchor_samples(spark, sf_dir):
    """Anchors of every document by thirds; a quarter of the documents has no sentence in one column and gets relaxed ones."""
    pages = lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("page"), "text", ((F.col("doc_id") % 3 != 2) | (F.col("chunk_index") % 2 == 0)).alias("prose"))
    parts = pages.select("doc", "page", F.posexplode(F.split("text", "\\. ")).alias("seq", "text"))
    sentences = parts.select("doc", "page", "seq", F.concat("text", F.lit(".")).alias("text"), (F.col("doc") % 4 != 1).alias("in_column"))
    return anchors.sample_anchors(sentences, pages, least_chars=100).withColumnRenamed("doc", "doc_id")
