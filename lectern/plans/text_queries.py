"""Scalar functions, projections and front-matter classes over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import frontmatter as fm
from lectern.functions import text as t
from lectern.plans.registry import LINES, lines, query, table

_WORDS = "list_filter(string_split_regex({}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')"
_TERMS = "terms AS (SELECT DISTINCT unnest(" + _WORDS.format("text") + ") AS term FROM documents)"
_STRIP = "regexp_replace(replace(lower(term), 'ß', 'ss'), '[^a-z0-9äöü]', '', 'g')"


def _suffix(s: str, suffixes: list[str], ok: str) -> str:
    cases = " ".join(f"WHEN {s} LIKE '%{x}' AND {ok.format(s=s, n=len(x))} THEN left({s}, length({s}) - {len(x)})" for x in suffixes)
    return f"CASE {cases} ELSE {s} END"


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(t.words(F.col("text"))).alias("term")).distinct()


@query(f"""WITH {_TERMS}, s AS (SELECT term, {_STRIP} AS p FROM terms),
f AS (SELECT term, p, replace(replace(p, 'theory', 'theorie'), 'sustainability', 'nachhaltigkeit') AS q FROM s)
SELECT term, {_suffix('q', ['en', 'er', 'e', 's'], 'strlen({s}) >= 6')} AS norm, {_suffix('p', ['en', 'er', 'e', 's'], 'strlen({s}) >= 6')} AS norm_plain FROM f""")
def norm_term(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", t.norm_term(F.col("term")).alias("norm"), t.norm_term(F.col("term"), families=False).alias("norm_plain"))


@query(f"""WITH {_TERMS}, s AS (SELECT term, lower(term) AS f FROM terms)
SELECT term, {_suffix('f', ['es', 'en', 's', 'n', 'e'], 'strlen({s}) - {n} >= 5')} AS stem FROM s""")
def alias_stem(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", t.alias_stem(F.col("term")).alias("stem"))


@query(f"""WITH {_TERMS} SELECT term, regexp_replace(lower(term), '[^a-z0-9ä-üß]', '', 'g') AS title_key,
regexp_replace(lower(term), '[^A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}]', '', 'g') AS canonical FROM terms""")
def form_keys(spark, sf_dir):
    return _terms(spark, sf_dir).select("term", t.title_key(F.col("term")).alias("title_key"), t.canonical_form(F.col("term")).alias("canonical"))


@query(f"""WITH {LINES} SELECT chunk_id, floor(len({_WORDS.format('text')}) * 13 / 10)::INT AS tokens,
len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')))::INT AS distinct_tokens FROM lines""")
def token_count(spark, sf_dir):
    return lines(spark, sf_dir).select("chunk_id", t.token_count(F.col("text")).alias("tokens"), F.size(t.token_set(F.col("text"))).alias("distinct_tokens"))


def _hits(known: list[str]) -> str:
    return "len(list_intersect(head, [" + ", ".join(f"'{w}'" for w in known) + "]))"


@query(f"""WITH h AS (SELECT doc_id, list_distinct(({_WORDS.format('lower(text)')})[1:500]) AS head FROM documents)
SELECT doc_id, CASE WHEN {_hits(t.GERMAN)} > {_hits(t.ENGLISH)} THEN 'de' ELSE 'en' END AS lang FROM h""")
def lang_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.detect_language(F.col("text")).alias("lang"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def year_parse(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", t.year_of(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("year"))


@query("""SELECT event_id, coalesce(greatest(5, least(40, try_cast(json_extract_string(props, '$.k') AS BIGINT))), 10)::INT AS k FROM events""")
def clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.clamp_param(F.get_json_object("props", "$.k"), 10, 5, 40).alias("k"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS d FROM documents),
u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(d, 8) || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] ELSE left(d, 36) END AS id FROM h)
SELECT doc_id, regexp_full_match(id, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS is_uuid FROM u""")
def uuid_filter(spark, sf_dir):
    d = F.sha2("text", 256)
    dashed = F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))
    named = F.when(F.col("doc_id") % 2 == 0, dashed).otherwise(F.substring(d, 1, 36))
    return table(spark, sf_dir, "documents").select("doc_id", t.is_uuid(named).alias("is_uuid"))


@query("""SELECT page_id, list_filter(regexp_extract_all(html, '<img[^>]*src="([^"]+)"', 1), lambda x: NOT regexp_matches(x, '^https?://')) AS refs,
list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda x: regexp_extract(x, '[^/]*$', 0)) AS link_names FROM pages""")
def image_refs(spark, sf_dir):
    as_markdown = F.regexp_replace("html", '<img[^>]*src="([^"]+)"', "![]($1)")
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), lambda x: F.regexp_extract(x, "[^/]*$", 0))
    return table(spark, sf_dir, "pages").select("page_id", t.image_refs(as_markdown).alias("refs"), links.alias("link_names"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[*_`#>]+', '', 'g'), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS body,
regexp_replace(regexp_replace(html, '</?(span|div)[^>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS bare FROM pages""")
def markup_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.plain_markup(F.col("html")).alias("body"), t.strip_styling(F.col("html")).alias("bare"))


@query("SELECT event_id, least(3600.0, 5.0 * pow(2.0, greatest(json_extract_string(props, '$.k')::INT % 14, 1) - 1)) AS seconds FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.backoff_seconds(F.get_json_object("props", "$.k").cast("int") % 14).alias("seconds"))


@query("""SELECT doc_id, sha256(text || '') AS content_hash, doc_id || ':' || sha256(text) || ':' || sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS idempotency_key FROM documents""")
def idempotency_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), t.idempotency_key(F.col("doc_id").cast("string"), F.sha2("text", 256), t.profile_hash("lang", "source")).alias("idempotency_key"))


@query("""WITH RECURSIVE s(v, r, n) AS (SELECT [1000,900,500,400,100,90,50,40,10,9,5,4,1], ['m','cm','d','cd','c','xc','l','xl','x','ix','v','iv','i'], 0),
k AS (SELECT DISTINCT p_size AS n FROM part),
roll(n, rest, label, i) AS (SELECT n, n, '', 1 FROM k UNION ALL
  SELECT roll.n, rest % s.v[i], label || repeat(s.r[i], (rest // s.v[i])::INT), i + 1 FROM roll, s WHERE i <= 13)
SELECT n, label, n AS back FROM roll WHERE i = 14""")
def roman_labels(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct().withColumn("label", t.roman(F.col("n")))
    return n.withColumn("back", t.roman_value(F.col("label")))


@query(f"""WITH {LINES} SELECT chunk_id, round(('0x' || left(sha256(text), 2))::INT / 127.5 - 1, 6) AS x,
round(('0x' || sha256(text)[3:4])::INT / 127.5 - 1, 6) AS y, round(('0x' || sha256(text)[5:6])::INT / 127.5 - 1, 6) AS z FROM lines""")
def hashed_vectors(spark, sf_dir):
    v = lines(spark, sf_dir).select("chunk_id", t.hashed_vector(F.col("text")).alias("v"))
    return v.select("chunk_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("z"))


def _pages(docs):
    """Documents in the shapes that the classifier knows: every 7th gets one of its typical bodies around its own first words."""
    first = F.element_at(t.words(F.col("text")), 1)
    rows = lambda f, n: F.concat_ws("\n", *[f(i) for i in range(n)])
    shapes = [
        F.concat(F.lit("### **Inhaltsverzeichnis**\n"), F.col("text")),
        F.concat(F.lit("# Vorwort-\n"), F.col("text")),
        rows(lambda i: F.concat(F.lit(f"| {i}.1 "), first, F.lit(f" | {10 + i} |")), 5),
        rows(lambda i: F.concat(F.lit(f"{i + 1}.2 "), first, F.lit(f" ..... {20 + i}")), 5),
        rows(lambda i: F.concat(F.lit("- "), first, F.lit(f", A. ({1990 + i}): Title, In: Verlag X, S. {i + 3}")), 6),
        rows(lambda i: F.concat(F.lit("Kapital"), F.lit(f" 4{i}, Markt 5{i} Umsatz, 16{i}")), 3),
        F.col("text"),
    ]
    body = shapes[-1]
    for i, s in enumerate(shapes[:-1]):
        body = F.when(F.pmod("doc_id", F.lit(7)) == i, s).otherwise(body)
    return docs.select("doc_id", body.alias("text"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'toc' WHEN 1 THEN 'preface' WHEN 2 THEN 'toc' WHEN 3 THEN 'toc' WHEN 4 THEN 'bibliography' WHEN 5 THEN 'index' ELSE '' END AS class,
doc_id % 7 < 5 AS front_matter FROM documents""")
def frontmatter_class(spark, sf_dir):
    return _pages(table(spark, sf_dir, "documents")).select("doc_id", fm.front_matter_class(F.col("text")).alias("class"), fm.is_front_matter(F.col("text")).alias("front_matter"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'toc' WHEN 1 THEN 'preface' WHEN 2 THEN 'toc' WHEN 3 THEN 'toc' WHEN 4 THEN 'bibliography' WHEN 5 THEN 'index' ELSE '' END AS class FROM documents)
SELECT coalesce(class, 'total') AS class, count(*) AS documents, (count(*) FILTER (class <> '')) AS gated FROM c GROUP BY ROLLUP (class)""")
def gate_counts(spark, sf_dir):
    return _gated(frontmatter_class(spark, sf_dir))


def _gated(c):
    counted = c.rollup("class").agg(F.count("*").alias("documents"), F.count_if(F.col("class") != "").alias("gated"))
    return counted.select(F.coalesce("class", F.lit("total")).alias("class"), "documents", "gated")


@query()
def frontmatter_class_texts(spark, sf_dir):
    """``frontmatter_class`` of every document's own text."""
    return table(spark, sf_dir, "documents").select("doc_id", fm.front_matter_class(F.col("text")).alias("class"), fm.is_front_matter(F.col("text")).alias("front_matter"))


@query()
def gate_counts_texts(spark, sf_dir):
    """``gate_counts`` of every document's own text."""
    return _gated(frontmatter_class_texts(spark, sf_dir))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN 'Kap. 2, S. ' || p_size || '-' || (p_size + 1) WHEN 2 THEN p_brand || ' · PDF-S. ' || (p_size + 1) WHEN 3 THEN 'S. ' || (p_size + 1) ELSE 'Kap. 2' END AS label FROM part""")
def locator_labels(spark, sf_dir):
    n = F.col("p_size")
    kind = n % 5
    text = lambda c: c.cast("string")
    loc = F.struct(
        F.when(kind == 0, "epub_cfi").otherwise("page_span").alias("type"),
        F.when(kind == 1, text(n)).when(kind == 2, "xx").alias("page_label_start"), F.when(kind == 1, text(n + 1)).alias("page_label_end"),
        F.when(kind.isin(2, 3), n).alias("physical_page_start"), F.when(kind == 2, "physical_only").alias("page_source"), F.when(kind.isin(1, 4), "2").alias("chapter"),
    )
    titles = F.when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", t.locator_label(loc, titles).alias("label"))
