"""Single operators over the test tables: parts and orders stand for items, attachments, jobs, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.functions import text as t
from lectern.operators import anchors, chunk, extract, graph, jobs, locate, persist, repair, search, sync, trust
from lectern.plans.registry import LINES, lines, query, table
from lectern.sources import files, library
from lectern.streaming import outbox


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def _creator(kind, first, last, name):
    return F.struct(*[F.lit(x).cast("string").alias(c) for c, x in (("creatorType", kind), ("firstName", first), ("lastName", last), ("name", name))])


def _items(spark, sf_dir):
    """Parts as raw items: acts, reports, books and attachments by size."""
    kind = F.element_at(F.array(*map(F.lit, ("statute", "report", "attachment", "book"))), F.col("p_size") % 4 + 1)
    year = F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-05-01"))
    creators = F.array(_creator("author", None, None, F.col("p_brand")), _creator("author", "Eva", F.col("p_type"), None), _creator(None, " ", None, None))
    fields = F.struct(
        kind.alias("itemType"), F.when(kind != "statute", F.col("p_name")).alias("title"), F.when(kind == "statute", F.col("p_name")).alias("nameOfAct"), F.when(kind != "statute", year).alias("date"),
        F.when(kind == "statute", year).alias("dateEnacted"), F.when(kind == "book", F.col("p_brand")).otherwise(" ").alias("publisher"), F.col("p_type").alias("institution"), creators.alias("creators"),
        F.array(F.struct(F.col("p_type").alias("tag"))).alias("tags"), F.when(F.col("p_size") % 3 == 0, 1).alias("deleted"), F.lit("application/pdf").alias("contentType"), F.col("p_name").alias("filename"),
    )
    return _parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("version"), F.col("p_brand").alias("parentItem"), F.from_json(F.to_json(fields), library.DATA).alias("data"))


@query("""SELECT p_partkey::VARCHAR AS key, p_name AS title, p_size + 1950 AS year, CASE p_size % 4 WHEN 1 THEN p_type WHEN 3 THEN p_brand END AS publisher, [p_brand, 'Eva ' || p_type] AS authors, [p_type] AS tags FROM part WHERE p_size % 4 <> 2""")
def item_documents(spark, sf_dir):
    return library.normalize(_items(spark, sf_dir)).select("key", "title", "year", "publisher", "authors", "tags")


@query("SELECT p_partkey::VARCHAR AS key, p_brand AS parent_key, 'application/pdf' AS content_type, p_name AS filename, p_size % 3 = 0 AS deleted FROM part WHERE p_size % 4 = 2")
def item_attachments(spark, sf_dir):
    return library.attachments(_items(spark, sf_dir)).drop("link_mode")


@query("SELECT 'changed' AS part, count(*) FILTER (p_partkey > 50) AS n FROM part UNION ALL SELECT 'cursor', greatest(50, max(p_partkey)) FROM part UNION ALL SELECT 'kept', 10000000000")
def item_cursor(spark, sf_dir):
    items = _items(spark, sf_dir)
    changed = library.increment(items, 50).agg(F.lit("changed").alias("part"), F.count("*").alias("n"))
    moved = library.next_cursor(items, 50).select(F.lit("cursor"), "cursor")
    kept = library.next_cursor(items, 10_000_000_000).select(F.lit("kept"), "cursor")
    return changed.union(moved).union(kept)


@query("SELECT p_partkey::VARCHAR AS key FROM part WHERE p_size % 3 = 0 UNION SELECT 'gone' || c_custkey FROM customer")
def deletion_keys(spark, sf_dir):
    removed = table(spark, sf_dir, "customer").select(F.concat(F.lit("gone"), F.col("c_custkey")).alias("key"))
    return library.deleted_events(_items(spark, sf_dir), removed)


@query("""WITH d AS (SELECT 'c' || c_custkey AS key FROM customer WHERE c_acctbal < 0 UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT 'o' || o_orderkey AS key, o_orderpriority LIKE '1%' OR 'o' || o_orderkey IN (SELECT key FROM d) OR 'c' || o_custkey IN (SELECT key FROM d) AS deleted FROM orders""")
def delete_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.select(F.concat(F.lit("o"), "o_orderkey").alias("key"), F.concat(F.lit("c"), "o_custkey").alias("parent_key"), F.col("o_orderpriority").startswith("1").alias("deleted"))
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("key"))
    return sync.apply_deletes(items, sync.deleted_keys(gone, o.filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("key")))).select("key", "deleted")


@query("""SELECT o_custkey AS document_id, o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 < 2
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) = 1""")
def attachment_choice(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("application/pdf", "application/epub+zip", "text/html"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("key"), kinds.alias("content_type"), (F.col("o_orderstatus") == "P").alias("deleted"))
    return sync.preferred_attachment(rows).select("document_id", "key")


_SNAPS = "s AS (SELECT o_orderkey AS id, o_custkey AS a, o_orderstatus = 'F' AS active, o_orderdate AS made FROM orders)"


def _snapshots(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("attachment_id"), (F.col("o_orderstatus") == "F").alias("active"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH {_SNAPS} SELECT id, c_acctbal >= 0 AND row_number() OVER (PARTITION BY a ORDER BY active DESC, made DESC, id DESC) = 1 AS active FROM s JOIN customer ON c_custkey = a")
def snapshot_revival(spark, sf_dir):
    live = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("attachment_id"), (F.col("c_acctbal") < 0).alias("deleted"))
    return sync.retire_and_revive(_snapshots(spark, sf_dir), live).select("id", "active")


@query(f"WITH {_SNAPS} SELECT a AS attachment_id, count(*) AS n FROM s WHERE active GROUP BY a HAVING count(*) > 1")
def one_active(spark, sf_dir):
    return sync.active_once(_snapshots(spark, sf_dir))


@query("""WITH m AS (SELECT 'Brand#' || i AS k, CASE WHEN i % 2 = 0 THEN 'included' ELSE 'excluded' END AS mode FROM range(1, 60) t(i))
SELECT k AS collection_key, mode, coalesce(list_sort(list(p_partkey) FILTER (p_partkey IS NOT NULL)), []) AS document_ids, count(p_partkey) AS documents FROM m LEFT JOIN part ON p_brand = k GROUP BY ALL""")
def selection_view(spark, sf_dir):
    members = _parts(spark, sf_dir).select(F.col("p_brand").alias("collection_key"), F.col("p_partkey").alias("document_id"))
    modes = spark.range(1, 60).select(F.concat(F.lit("Brand#"), "id").alias("collection_key"), F.when(F.col("id") % 2 == 0, "included").otherwise("excluded").alias("mode"))
    return sync.resolved_view(members, modes)


@query("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'xx' ELSE lang END")
def metadata_backfill(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select("doc_id", "lang")
    fresh = stored.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "xx").otherwise(F.col("lang")))
    return sync.changed_only(stored, fresh, "doc_id", ["lang"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN [] ELSE [source] END AS authors, [lang] AS tags FROM documents")
def source_views(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return sync.source_view(d.select("doc_id", F.when(~F.col("lang").eqNullSafe("de"), F.array("source")).alias("authors"), F.array("lang").alias("tags")))


@query("SELECT max(len(embedding))::INT AS dim FROM embeddings")
def first_dimension(spark, sf_dir):
    return sync.any_dimension(table(spark, sf_dir, "embeddings"), "embedding")


_WHY = ["PARENT_REMOVED", "PARENT_REMOVED", "ATTACHMENT_REMOVED", "PARENT_REMOVED", "ATTACHMENT_REMOVED", "ATTACHMENT_REMOVED", "ATTACHMENT_NOT_PREFERRED", "PARENT_REMOVED", "PARENT_REMOVED", "CONTENT_HASH_MISSING", "CONTENT_HASH_CHANGED", "CANONICAL_METADATA_MISSING"]


@query(f"SELECT p_partkey AS job_id, CASE p_size % 14 {' '.join(f'WHEN {i} THEN {chr(39)}{x}{chr(39)}' for i, x in enumerate(_WHY))} END AS reason FROM part")
def job_obsolescence(spark, sf_dir):
    k = F.col("p_size") % 14
    job = F.struct(F.when(k != 0, "s").alias("source_id"), F.lit("d").alias("document_id"), F.when(k != 3, "a").alias("attachment_id"), F.lit("h").alias("content_hash"), (k == 13).alias("force"))
    doc = F.when(k != 1, F.struct((k == 2).alias("deleted"), F.when(k == 7, "other").otherwise("s").alias("source_id"), F.lit("k").alias("key")))
    att = F.when(k != 4, F.struct((k == 5).alias("deleted"), (k != 6).alias("preferred"), F.lit("d").alias("document_id"), F.when(k != 8, "k").alias("parent_key"), F.when(k == 9, "").when(k.isin(10, 13), "new").otherwise("h").alias("content_hash")))
    made = _parts(spark, sf_dir).select("p_partkey", job.alias("j"), doc.alias("d"), att.alias("a"), F.when(k != 11, F.struct(F.lit(1).alias("x"))).alias("item"))
    return made.select(F.col("p_partkey").alias("job_id"), jobs.obsolescence(F.col("j"), F.col("d"), F.col("a"), F.col("item")).alias("reason"))


def _jobs(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("pending", "claimed", "processing", "completed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("enqueued_at"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("lease_until"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("next_attempt_at"), (F.col("o_orderkey") % 5).alias("attempt"), F.lit(3).alias("max_attempts"),
    )


@query("""SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 5 < 3 AND ((o_orderkey % 4 = 0 AND (o_orderkey % 3 <> 0 OR o_custkey <= 60)) OR (o_orderkey % 4 IN (1, 2) AND o_custkey <= 60))
ORDER BY o_orderkey % 4 IN (1, 2) DESC, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END NULLS LAST, o_orderdate, o_orderkey LIMIT 200""")
def claim_batch(spark, sf_dir):
    """The next 200 jobs that workers may claim."""
    return jobs.claim_order(_jobs(spark, sf_dir), F.lit(60)).limit(200).select("job_id")


@query("SELECT o_custkey AS source_id, count(*) AS jobs FROM orders GROUP BY o_custkey")
def job_counts(spark, sf_dir):
    return jobs.job_counts(_jobs(spark, sf_dir))


@query("SELECT o_custkey AS source_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM orders QUALIFY place <= 5")
def newest_jobs(spark, sf_dir):
    """The five jobs of each source that were made last."""
    return jobs.newest_jobs(_jobs(spark, sf_dir), 5).select("source_id", "job_id", "place")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS snapshot_id FROM orders WHERE o_orderkey % 4 = 3
ORDER BY CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE 9 END, o_orderkey LIMIT 50""")
def ack_ledger(spark, sf_dir):
    """The 50 jobs whose acknowledgement waits longest."""
    told = F.when(F.col("source_id") % 3 == 0, 7)
    marked = _jobs(spark, sf_dir).withColumn("ack_pending_at", jobs.ack_failed(F.col("status"), told, F.lit(9))).withColumn("snapshot_id", F.when(F.col("source_id") % 2 == 0, F.col("source_id").cast("string")))
    return jobs.pending_acks(marked, 0)


@query("SELECT o_orderkey AS job_id, o_custkey AS source_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def listed_jobs(spark, sf_dir):
    """The 50 jobs of all sources that were entered last."""
    return jobs.list_jobs(_jobs(spark, sf_dir).withColumn("enqueued_at", F.col("created_at")), 0).select("job_id", "source_id")


@query("SELECT o_orderkey AS job_id, o_orderkey % 4 = 3 AND NOT (o_orderkey % 4 = 3 AND o_custkey % 2 = 0) AS pending FROM orders")
def cleared_acks(spark, sf_dir):
    """Marks of completed jobs, less those of even sources, which are acknowledged."""
    marked = _jobs(spark, sf_dir).withColumn("ack_pending_at", jobs.ack_failed(F.col("status"), F.lit(None).cast("int"), F.lit(9)))
    return jobs.clear_acks(marked, marked.filter("source_id % 2 = 0")).select("job_id", F.col("ack_pending_at").isNotNull().alias("pending"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' AND value > 50 THEN 'upsert' WHEN event_type = 'error' AND value <= 50 THEN 'delete' ELSE 'skip' END AS decision,
event_id % 12 + 1 AS attempts, CASE WHEN user_id % 2 = 0 THEN 'done' WHEN event_id % 12 + 1 >= 10 THEN 'dead' ELSE 'retry' END AS state FROM events""")
def outbox_decisions(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    tried = outbox.retry_state(F.col("event_id") % 12, F.col("user_id") % 2 == 1)
    return table(spark, sf_dir, "events").select("event_id", outbox.decide(op, F.col("value") > 50).alias("decision"), tried.alias("r")).select("event_id", "decision", "r.attempts", "r.state")


@query("""WITH e AS (SELECT user_id, event_type, event_id, value FROM events), x AS (SELECT user_id, value FROM e WHERE event_id % 2 = 0 AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
l AS (SELECT * FROM e WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, value FROM x WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, value FROM l WHERE event_type <> 'error'""")
def index_deletes(spark, sf_dir):
    """An index after a second batch that upserts and deletes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    first = outbox.merged(None, e.filter("event_id % 2 = 0 AND op = 'upsert'"), "user_id", ["event_id"])
    return outbox.merged(first, e.filter("event_id % 2 = 1"), "user_id", ["event_id"]).select("user_id", "value")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    counted = outbox.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type")
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT p_partkey, '/lib/' || p_name || '+' || p_partkey || '.pdf' AS path, '/6/' || p_size || '!/4' AS cfi, left(p_name, 5) || 'ö' AS cut, '![a](x_' || p_partkey || '.png) t' AS image,
[p_size, p_size + 4]::INT[] AS offsets, '[0.5,' || p_size || '.0]' AS vector FROM part""")
def small_forms(spark, sf_dir):
    n = F.col("p_size").cast("string")
    bounds = F.concat(F.lit('[["'), n, F.lit('","1"],['), (F.col("p_size") + 4).cast("string"), F.lit(',"2"],["x","y"],[3]]'))
    return _parts(spark, sf_dir).select(
        "p_partkey", t.decode_file_url(F.concat(F.lit("file:///lib/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"), F.col("p_partkey"), F.lit(".pdf"))).alias("path"),
        t.short_cfi(F.concat(F.lit("epubcfi(/6/"), n, F.lit("!/4,/1:0,/1:5)"))).alias("cfi"), t.truncate_bytes(F.concat(F.substring("p_name", 1, 5), F.lit("öäü")), 8).alias("cut"),
        t.image_basenames(F.concat(F.lit("![a](/tmp/"), F.col("p_type"), F.lit("/x_"), F.col("p_partkey"), F.lit(".png) t"))).alias("image"),
        F.transform(locate.paragraph_pages(bounds), lambda p: p["offset"]).alias("offsets"), t.vector_text(F.array(F.lit(0.5), F.col("p_size").cast("double"))).alias("vector"),
    )


@query("SELECT p_partkey, p_brand AS token, p_size * 0.5 AS weight, (('0x' || substring(sha256(lower(p_brand)), 50, 15))::UBIGINT % 1000)::VARCHAR AS slot FROM part")
def sparse_weights(spark, sf_dir):
    told = t.sparse_map(F.concat(F.lit('{"'), F.col("p_brand"), F.lit('": "'), (F.col("p_size") * 0.5).cast("string"), F.lit('"}')))
    return _parts(spark, sf_dir).select("p_partkey", told.alias("w"), F.map_keys(t.hashed_sparse(F.col("p_brand")))[0].alias("slot")).select("p_partkey", F.explode("w").alias("token", "weight"), "slot")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'Unbekannt' END || ' - ' || CASE WHEN p_size % 2 = 0 THEN (p_size + 1950)::VARCHAR || ' ' ELSE '' END || '- ' || p_name || ' B.pdf' AS name FROM part""")
def file_names(spark, sf_dir):
    k = F.col("p_size") % 3
    by = F.when(k == 0, F.array(_creator("editor", "", "X", ""), _creator("author", "Eva", F.col("p_brand"), ""))).otherwise(F.array().cast(f"array<{library.CREATOR}>"))
    return _parts(spark, sf_dir).select("p_partkey", t.schema_filename(by, F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1950), F.concat("p_name", F.lit("/ B")), F.when(k == 1, F.col("p_type"))).alias("name"))


@query("SELECT p_partkey, 'a ' || chr(10) || chr(10) || '{' || p_size || '}' || repeat('-', 48) || chr(10) || chr(10) || ' b' AS text FROM part")
def epub_page_markers(spark, sf_dir):
    page = (F.col("p_size") + 1).cast("string")
    return _parts(spark, sf_dir).select("p_partkey", files.page_markers(F.concat(F.lit('a <span id="x_page_'), page, F.lit('"></span>['), page, F.lit("] b"))).alias("text"))


@query(r"""WITH l AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN replace(text, ' ', chr(9)) || ' Tabelle' ELSE text END AS line FROM conversations WHERE turn < 3)
SELECT conv_id, (sum(length(line) - length(replace(line, chr(9), ''))) > 5)::INT + (count(*) FILTER (regexp_matches(line, '\S {3,}\S+ {3,}\S')) > 5)::INT + (count(*) FILTER (regexp_matches(line, '(?i)\b(table|tabelle|figure|abbildung)\b')) > 2)::INT >= 2 AS has_table FROM l GROUP BY conv_id""")
def table_presence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.when(F.col("conv_id") % 2 == 0, F.concat(F.replace("text", F.lit(" "), F.lit("\t")), F.lit(" Tabelle"))).otherwise(F.col("text"))
    return files.has_tables(c.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


@query("SELECT p_partkey, p_size >= 8 AND (p_partkey % 40) < 20 * p_size AND p_partkey % 3 > 0 AS scan, CASE WHEN p_size % 3 = 0 THEN 'folio_verified' WHEN p_size % 4 = 0 THEN 'pdf_label_sane' ELSE 'physical_only' END AS source, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR WHEN p_size % 4 = 0 THEN 'iv' END AS label FROM part")
def page_trust(spark, sf_dir):
    n = F.col("p_size")
    level = trust.trust_level(F.when(n % 3 == 0, n), F.lit("iv"), n % 4 == 0)
    scan = trust.is_raster_scan(n, F.col("p_partkey") % 40, n, F.when(F.col("p_partkey") % 3 > 0, 1_600_000_000).otherwise(1_500_000_000))
    return _parts(spark, sf_dir).select("p_partkey", scan.alias("scan"), level.alias("l")).select("p_partkey", "scan", "l.source", "l.label")


@query("""WITH h AS (SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 2 = 0 THEN 'lead' ELSE 'bare' END AS form, ((turn * conv_id) % 3)::VARCHAR AS value FROM conversations), n AS (SELECT doc, count(*) AS pages FROM h GROUP BY doc),
k AS (SELECT doc, value FROM h JOIN n USING (doc) WHERE form = 'lead' GROUP BY doc, value, pages HAVING pages >= 4 AND count(*) >= greatest(2, (pages + 2) // 3))
SELECT doc, page, form, value FROM h WHERE form = 'bare' OR NOT EXISTS (SELECT 1 FROM k WHERE k.doc = h.doc AND k.value = h.value)""")
def constant_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(F.col("turn") % 2 == 0, "lead").otherwise("bare").alias("form"), ((F.col("turn") * F.col("conv_id")) % 3).cast("string").alias("value"), F.lit("top").alias("zone"), F.lit(0).alias("seq"))
    return trust.drop_constants(c, c.groupBy("doc").agg(F.count("*").alias("page_count"))).select("doc", "page", "form", "value")


@query("""SELECT p_partkey AS doc, CASE p_size % 7 WHEN 0 THEN 'bare' WHEN 1 THEN 'roman' WHEN 2 THEN 'trail' WHEN 3 THEN 'lseries' WHEN 4 THEN 'eli' WHEN 5 THEN 'weak' END AS form,
CASE p_size % 7 WHEN 1 THEN 'iv' WHEN 5 THEN '1999' ELSE (p_partkey % 900 + 1)::VARCHAR END AS value FROM part WHERE p_size % 7 < 6""")
def folio_harvest(spark, sf_dir):
    n, k = (F.col("p_partkey") % 900 + 1).cast("string"), F.col("p_size") % 7
    line = F.when(k == 0, n).when(k == 1, "IV").when(k == 2, F.concat(F.lit("A heading "), n)).when(k == 3, F.concat(F.lit("OJ L 333/"), n)).when(k == 4, F.concat(n, F.lit("/1000"))).when(k == 5, "1999").otherwise(F.concat(F.lit("see page "), n, F.lit(".")))
    return trust.harvest_lines(_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc"), F.lit(0).alias("page"), F.lit("top").alias("zone"), F.lit(0).alias("seq"), line.alias("line"))).select("doc", "form", "value")


@query("SELECT p_partkey AS doc, ['unclassifiable', 'constant-offset', 'reprint-start', 'two-range', 'injection'][p_size % 5 + 1] AS class FROM part")
def label_classes(spark, sf_dir):
    k = F.col("p_size") % 5
    row = lambda page, label, truth: F.struct(F.lit(page).alias("page"), label.alias("label"), F.lit(truth).alias("truth"))
    first = row(3, F.when(k == 1, "1").when(k == 2, "4").when(k == 3, "5").otherwise(""), "6")
    second = row(9, F.when(k == 1, "7").when(k == 2, "10").when(k == 3, "13").otherwise(""), "12")
    each = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc"), F.explode(F.when(k == 0, F.array(first)).otherwise(F.array(first, second))).alias("a"))
    return repair.offset_classes(each.select("doc", "a.page", "a.label", "a.truth")).select("doc", "class")


@query("""SELECT p_partkey AS doc, CASE p_size % 3 WHEN 0 THEN [0] WHEN 1 THEN [0, 3] END AS starts, CASE p_size % 3 WHEN 0 THEN [p_size + 2] WHEN 1 THEN [1, p_size] END AS firsts,
CASE p_size % 3 WHEN 2 THEN 'unclassifiable' END AS refused FROM part""")
def relabel_plans(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_size") % 3
    spec = F.when(k == 0, F.array(F.struct(F.lit(0), F.lit(""), F.lit("D"), F.lit(1)))).otherwise(F.array()).cast(f"array<{repair.RANGE}>")
    found = F.array(F.struct(F.lit(3).alias("page"), F.when(k == 0, 4).alias("n"), F.when(k == 0, n + 5).otherwise(n).cast("int").alias("m")))
    kind = F.element_at(F.array(*map(F.lit, ("constant-offset", "injection", "unclassifiable"))), k + 1)
    books = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc"), kind.alias("class"), spec.alias("spec"), found.alias("anchors"), F.array().cast("array<struct<page:int,value:int>>").alias("folio"))
    each = lambda field: F.transform("spec", lambda r: r[field])
    return repair.plans(books).select("doc", each("startpage").alias("starts"), each("firstpagenum").alias("firsts"), "refused")


@query("""SELECT conv_id AS doc, CASE WHEN turn % 5 = 4 THEN 'p' || turn ELSE (turn + 1)::VARCHAR END AS page, CASE WHEN turn % 5 < 3 AND turn % 2 = 0 THEN (turn + 10)::VARCHAR END AS folio,
CASE WHEN turn % 5 = 4 THEN 'not a page number' WHEN turn % 2 = 1 OR turn % 5 = 3 THEN 'page not verified' ELSE 'contradicts folio' END AS reason FROM conversations WHERE turn % 5 >= 3 OR turn % 2 = 1 OR turn % 3 = 0""")
def plan_faults(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn")
    page = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("p"), "turn")).otherwise((F.col("turn") + 1).cast("string"))
    label = F.when(F.col("turn") % 3 == 0, "x").otherwise((F.col("turn") + 10).cast("string"))
    proven = c.filter("turn % 2 = 0 AND turn % 5 <> 3").select("doc", F.col("turn").alias("page"), (F.col("turn") + 10).alias("value"))
    return repair.plan_check(c.select("doc", page.alias("page"), label.alias("label")), proven).select("doc", "page", "folio", "reason")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 OR p_size % 3 = 1 THEN 'CONCEPT' ELSE 'ORGANIZATION' END AS type, p_size % 3 = 2 AS kept FROM part""")
def type_gate(spark, sf_dir):
    k = F.col("p_size") % 3
    e = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.when(k == 0, "Das  Management").when(k == 1, F.concat("p_name", F.lit(" Stakeholders"))).otherwise(F.col("p_name")).alias("form"), F.lit("ORGANIZATION").alias("type"))
    return graph.gate_types(e).select("id", "type", (F.col("type") == "ORGANIZATION").alias("kept"))


@query("SELECT l_suppkey AS source, l_partkey AS target, 'ship_' || lower(l_returnflag) AS type, max(l_quantity) AS strength, list_sort(list(DISTINCT l_orderkey)) AS evidence FROM lineitem GROUP BY ALL")
def relation_assembly(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.concat(F.lit(" Ship  "), "l_returnflag").alias("relation"), F.col("l_orderkey").alias("chunk_id"), F.col("l_quantity").alias("strength"))
    return extract.assemble(found)


@query("SELECT l_suppkey || '-' || l_partkey AS id FROM lineitem GROUP BY l_suppkey, l_partkey HAVING bool_or(l_orderkey % 10 = 0)")
def evidence_overlap(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", "l_suppkey", "l_partkey").alias("id")).agg(F.collect_set("l_orderkey").alias("evidence"))
    gated = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("chunk_id"))
    return graph.evidence_overlaps(r, gated).select("id")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_partkey ELSE p_size::BIGINT END AS root FROM part")
def root_lookup(spark, sf_dir):
    p = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), "p_size")
    entities = p.filter("p_size % 3 > 0").select("id", F.when(F.col("p_size") % 3 == 2, F.col("p_size").cast("long")).alias("alias_of"))
    return graph.root_of(p.select("id"), entities.filter("alias_of IS NULL").select(F.col("id").alias("root")), entities)


@query("""SELECT o_custkey AS survivor, o_orderkey AS loser, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def superseded_history(spark, sf_dir):
    archive = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("survivor"), F.col("o_orderkey").alias("loser"), F.col("o_orderdate").alias("archived_at"))
    asked = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("survivor"))
    return graph.superseded_history(archive, asked).select("survivor", "loser", "place")


@query("SELECT o_custkey AS survivor, o_orderkey AS loser, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS note FROM orders")
def superseded_archive(spark, sf_dir):
    rows = lambda note: table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("survivor"), F.col("o_orderkey").alias("loser"), F.lit("merge").alias("operation"), F.lit(note).alias("note"), "o_orderstatus")
    return persist.archive_superseded(rows("old").filter("o_orderstatus = 'F'"), rows("new").union(rows("new"))).select("survivor", "loser", "note")


@query("SELECT 'documents' AS part, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'none', 0")
def insert_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return persist.post_insert_counts({"documents": d, "labels": table(spark, sf_dir, "labels"), "none": d.filter("false")})


@query("""WITH g AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_custkey), m AS (SELECT *, v[len(v) // 2 + 1] AS mid FROM g)
SELECT o_custkey, mid >= 75000.0 AS prose, len(list_filter(v, lambda x: abs(x - mid) <= 60000)) / len(v) >= 0.6 AS one_column FROM m""")
def page_geometry(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return g.select("o_custkey", anchors.is_prose_page(F.col("v"), F.lit(150000.0)).alias("prose"), anchors.in_one_column(F.col("v"), within=60000).alias("one_column"))


@query("""SELECT p_partkey, 'The sentence about a ' || p_name || ' is long enough to stay whole here.' AS text, 4 + length(p_name) AS found, CASE WHEN p_size % 2 = 0 THEN '> Section: ' || p_brand || ' > ' || p_type || chr(10) || chr(10) || p_name ELSE p_name END AS input FROM part""")
def anchor_texts(spark, sf_dir):
    label = F.col("p_size").cast("string")
    said = F.concat(F.lit("INTRODUCTION "), label, F.lit(" | The sentence about a "), "p_name", F.lit(" is long enough to stay whole here."))
    hay = F.concat(F.lit("ab "), "p_name", F.lit(" long  –\n"), "p_brand", F.lit(" end"))
    titles = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return _parts(spark, sf_dir).select("p_partkey", anchors.running_head_off(said, label).alias("text"), anchors.tolerant_offset(hay, F.concat(F.lit("long - "), "p_brand")).alias("found"), chunk.embedding_input(F.col("p_name"), titles).alias("input"))


@query("""WITH h AS (SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id)::INT AS rank FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40),
f AS (SELECT *, query_id % 3 = 0 OR id % 2 = 0 AS front FROM h), k AS (SELECT *, count(*) FILTER (NOT front) OVER (PARTITION BY query_id) AS body FROM f)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM k WHERE NOT front OR body = 0""")
def front_matter_guard(spark, sf_dir):
    """Hits without front matter; where a query's hits are nothing else, all stay."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k"))
    pairs = b.join(ids.withColumn("k", F.col("doc") % 40), "k").select("query_id", "doc", F.concat_ws(":", "query_id", "doc").alias("id"))
    ranked = pairs.selectExpr("query_id", "id", "doc", "cast(row_number() OVER (PARTITION BY query_id ORDER BY doc) AS int) AS rank", "0.0D AS score")
    front = (F.col("query_id") % 3 == 0) | (F.col("doc") % 2 == 0)
    docs = ranked.select("id", F.when(front, "# Vorwort\nx").otherwise("Plain prose.").alias("text"))
    return search.drop_front_matter(ranked, docs).select("query_id", F.split("id", ":")[1].cast("long").alias("id"), "rank")


@query(f"""WITH {LINES}, c AS (SELECT *, doc_id % 4 > 0 AS active FROM lines), s AS (SELECT chunk_id, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM c WHERE active WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT i.doc_id, CASE WHEN c.chunk_id IS NULL THEN 'unknown' WHEN c.active THEN 'active' ELSE 'superseded' END AS state, s.text, s.before, s.after FROM documents i LEFT JOIN c ON c.chunk_id = i.doc_id || ':1' LEFT JOIN s ON s.chunk_id = c.chunk_id""")
def passages(spark, sf_dir):
    """The second line of each document with its neighbours and its state."""
    rows = lines(spark, sf_dir)
    chunks = rows.select("chunk_id", F.col("doc_id").alias("document_id"), F.col("doc_id").alias("attachment_id"), "chunk_index", "text", (F.col("doc_id") % 4 > 0).alias("active"))
    asked = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id"), F.lit(":1")).alias("chunk_id"))
    return Engine({"chunks": chunks}).passage(asked).select(F.split("chunk_id", ":")[0].cast("long").alias("doc_id"), "state", "text", "before", "after")


@query(f"""WITH {LINES} SELECT o_orderkey AS source, doc_id AS document_id, chunk_index, text FROM orders JOIN lines ON chunk_id = (o_orderkey % 200) || ':' || (o_orderkey % 3) WHERE doc_id % 4 > 0""")
def evidence_sources(spark, sf_dir):
    rows = lines(spark, sf_dir)
    chunks = rows.select("chunk_id", F.col("doc_id").alias("document_id"), "chunk_index", "text", (F.col("doc_id") % 4 > 0).alias("active"))
    told = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.lit("b").alias("target"), F.lit("is").alias("type"), F.array(F.concat_ws(":", F.col("o_orderkey") % 200, F.col("o_orderkey") % 3)).alias("evidence"))
    return Engine({"chunks": chunks}).evidence_sources(told).select("source", "document_id", "chunk_index", "text")


@query("SELECT doc_id AS chunk_id, quality, toxic, e.label FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings e ON vec_id = doc_id")
def index_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    sparse = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id")
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return locate.materialize(docs, dense, sparse).select("chunk_id", "quality", "toxic", "label")
