"""Synchronisation, jobs, page trust and passages over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import jobs, locate, sync, trust
from lectern.plans.registry import LINES, lines, query, table


@query("""SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o_custkey = c_custkey""")
def latest_per_key(spark, sf_dir):
    newest = sync.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, sf_dir, "customer")
    return c.join(newest, c["c_custkey"] == newest["o_custkey"], "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, (o_orderstatus <> 'F') DESC, o_orderkey DESC) = 1""")
def cdc_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("version", F.year("o_orderdate"))
    merged = sync.upsert(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), ["o_custkey"], "version", "o_orderkey")
    return merged.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS missing FROM customer")
def mark_missing(spark, sf_dir):
    batch = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sync.mark_missing(table(spark, sf_dir, "customer").select("c_custkey"), batch, "c_custkey", full_snapshot=True)


@query("SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def membership(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.select("l_suppkey", "p_brand").distinct()


@query("SELECT collection_key, item_key FROM (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_brand, ' ')) AS collection_key, p_partkey AS item_key FROM part)")
def membership_rebuild(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split(F.concat_ws(" ", "p_name", "p_brand"), " ").alias("collections"))
    return sync.memberships(items)


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_active(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(returned, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def anti_seeds(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(large, "o_orderkey", "left_anti").select("o_orderkey")


@query(f"WITH {LINES} SELECT chunk_id FROM lines WHERE text LIKE '%the %' UNION SELECT doc_id || ':0' FROM labels")
def union_evidence(spark, sf_dir):
    said = lines(spark, sf_dir).filter(F.col("text").contains("the "))
    marked = table(spark, sf_dir, "labels").select(F.array(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("0"))).alias("evidence"))
    return locate.union_evidence(said, marked)


@query("""WITH m AS (SELECT 'src' || i AS c, CASE WHEN i % 3 = 0 THEN 'included' ELSE 'excluded' END AS mode FROM range(0, 12) t(i)),
x AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id, NOT coalesce(mode = 'included', FALSE) OR doc_id IN (SELECT doc_id FROM x) AS excluded FROM documents LEFT JOIN m ON c = source""")
def selection_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection_key"))
    modes = spark.range(12).select(F.concat(F.lit("src"), F.col("id")).alias("collection_key"), F.when(F.col("id") % 3 == 0, "included").otherwise("excluded").alias("mode"))
    own = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("excluded").alias("mode"))
    out = sync.effective_selection(docs.select("document_id"), docs.select("collection_key", "document_id"), modes, own)
    return out.select(F.col("document_id").alias("doc_id"), "excluded")


@query("""WITH j AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'held' WHEN o_orderstatus = 'F' THEN 'synced' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'held' END AS sync_state FROM customer LEFT JOIN j ON o_custkey = c_custkey""")
def document_states(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "O", "pending")
    j = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("updated_at"), status.alias("status"))
    modes = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("document_id"), F.lit("excluded").alias("mode"))
    return sync.document_states(c.select(F.col("c_custkey").alias("document_id")), j, modes).select(F.col("document_id").alias("c_custkey"), "sync_state")


@query("""WITH k AS (SELECT DISTINCT o_custkey AS attachment_id, o_orderpriority AS content_hash FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT DISTINCT o_custkey AS attachment_id, o_orderpriority AS content_hash FROM orders WHERE o_orderstatus = 'O')
SELECT attachment_id, content_hash FROM w EXCEPT SELECT attachment_id, content_hash FROM k""")
def job_dedupe(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("attachment_id"), F.col("o_orderpriority").alias("content_hash"), "o_orderstatus", F.lit(False).alias("force"))
    return sync.new_jobs(o.filter("o_orderstatus = 'O'").drop("o_orderstatus"), o.filter("o_orderstatus = 'F'")).select("attachment_id", "content_hash")


@query("""WITH a AS (SELECT conv_id AS owner, count(*) AS n, count(DISTINCT turn) AS d, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE length(text) > 60 GROUP BY conv_id)
SELECT owner, 'CHUNK_INDEX_DUPLICATE' AS code FROM a WHERE d < n UNION ALL SELECT owner, 'CHUNK_INDEX_GAP' FROM a WHERE lo <> 0 OR hi <> d - 1
UNION ALL SELECT vec_id, 'DENSE_DIMENSIONS' FROM embeddings WHERE label = 3""")
def validate_violations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.length("text") > 60).withColumnRenamed("conv_id", "owner")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("owner"), F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return sync.violations([sync.index_violations(turns, "owner", "turn"), sync.vector_violations(v, "owner", "vector", 64)])


@query("""WITH a AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'ARTIFACT_DIGEST_MISMATCH' WHEN 2 THEN 'ARTIFACT_SIZE_MISMATCH' WHEN 3 THEN 'ARTIFACT_MISSING_RECORD' END AS code FROM pages)
SELECT page_id AS ref, code FROM a WHERE code IS NOT NULL""")
def artifact_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ref"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("size"), F.lit("text/html").alias("media_type"))
    k = F.col("ref") % 5
    told = p.filter(k != 3).withColumns({"sha256": F.when(k == 1, F.reverse("sha256")).otherwise(F.col("sha256")), "size": F.when(k == 2, F.col("size") + 1).otherwise(F.col("size"))})
    return sync.artifact_violations(p, told)


_EVENT = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'renew' WHEN 'purchase' THEN 'complete' ELSE 'fail' END"


@query(f"""WITH RECURSIVE ev AS (SELECT user_id, {_EVENT} AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, status, attempt, ignored) AS (SELECT DISTINCT user_id, 0::BIGINT, 'pending', 0, 0 FROM events UNION ALL
SELECT f.user_id, ev.k,
 CASE WHEN e = 'enqueue' AND status IN ('completed', 'failed') THEN 'pending' WHEN e = 'claim' AND status = 'pending' AND attempt < 3 THEN 'claimed' WHEN e = 'renew' AND status IN ('claimed', 'processing') THEN 'processing'
      WHEN e = 'complete' AND status IN ('claimed', 'processing') THEN 'completed' WHEN e = 'fail' AND status IN ('claimed', 'processing') THEN CASE WHEN attempt < 3 THEN 'pending' ELSE 'failed' END ELSE status END,
 CASE WHEN e = 'enqueue' AND status IN ('completed', 'failed') THEN 0 WHEN e = 'claim' AND status = 'pending' AND attempt < 3 THEN attempt + 1 ELSE attempt END,
 CASE WHEN (e = 'enqueue' AND status IN ('completed', 'failed')) OR (e = 'claim' AND status = 'pending' AND attempt < 3) OR (e IN ('renew', 'complete', 'fail') AND status IN ('claimed', 'processing')) THEN ignored ELSE ignored + 1 END
FROM f JOIN ev ON ev.user_id = f.user_id AND ev.k = f.k + 1)
SELECT user_id, status, attempt, ignored FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def job_fold(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "renew").when(F.col("event_type") == "purchase", "complete").otherwise("fail")
    return jobs.fold(table(spark, sf_dir, "events").withColumn("kind", kind), "user_id", ["ts", "event_id"], "kind")


_SNAP = "status IN ('claimed', 'processing')"


@query(f"""WITH j AS (SELECT event_id, ['pending', 'claimed', 'processing', 'completed'][(event_id % 4 + 1)::INT] AS status, event_type = 'error' AS cancel, value > 50 AS expired, (user_id % 4)::INT AS attempt FROM events)
SELECT event_id, CASE WHEN status = 'pending' AND cancel THEN 'cancelled' WHEN {_SNAP} AND cancel AND expired THEN 'cancelled' WHEN {_SNAP} AND expired AND attempt >= 3 THEN 'failed' WHEN status = 'pending' AND attempt >= 3 THEN 'failed' ELSE status END AS status,
CASE WHEN cancel AND (status = 'pending' OR ({_SNAP} AND expired)) THEN NULL WHEN {_SNAP} AND expired AND attempt >= 3 THEN 'LEASE_EXHAUSTED' WHEN status = 'pending' AND attempt >= 3 THEN 'RETRY_EXHAUSTED' END AS error_code,
CASE WHEN {_SNAP} AND expired AND cancel THEN 'cancelled' WHEN {_SNAP} AND expired AND attempt >= 3 THEN 'failed' WHEN {_SNAP} AND expired THEN 'pending' ELSE status END AS recovered FROM j""")
def lease_recovery(spark, sf_dir):
    names = F.array(*map(F.lit, ("pending", "claimed", "processing", "completed")))
    j = table(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("status"), (F.col("event_type") == "error").alias("cancel"), (F.col("value") > 50).alias("expired"), (F.col("user_id") % 4).alias("attempt"))
    args = (F.col("status"), F.col("cancel"), F.col("expired"), F.col("attempt"), F.lit(3))
    done = jobs.terminalized(*args)
    return j.select("event_id", done["status"].alias("status"), done["error_code"].alias("error_code"), jobs.recovered(*args).alias("recovered"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND value / 100 >= 0.95 AND user_id % 3 = 0 THEN 'in_repair' WHEN event_type = 'error' THEN 'failed' ELSE 'blocked' END AS status,
CASE WHEN user_id % 4 >= 2 THEN 'blocked' ELSE 'in_repair' END AS claimed FROM events""")
def repair_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "click", "auto_apply").when(F.col("event_type") == "error", "failed").otherwise("unclear")
    return e.select("event_id", jobs.verdict_status(verdict, F.col("value") / 100, F.col("user_id") % 3).alias("status"), jobs.repair_claim(F.lit("queued"), F.col("user_id") % 4).alias("claimed"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def outbox_latest(spark, sf_dir):
    return sync.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


_CAND = "SELECT conv_id AS doc, turn AS page, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE turn + 10 + CASE WHEN length(text) % 11 = 0 THEN 1 ELSE 0 END END AS value FROM conversations"
_RUNS = f"""c AS (SELECT * FROM ({_CAND}) WHERE value IS NOT NULL),
b AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND value = lag(value) OVER w + 1 THEN 0 ELSE 1 END AS brk FROM c WINDOW w AS (PARTITION BY doc ORDER BY page)),
g AS (SELECT doc, page, value, sum(brk) OVER (PARTITION BY doc ORDER BY page)::BIGINT AS run FROM b),
r AS (SELECT *, count(*) OVER (PARTITION BY doc, run) AS n FROM g QUALIFY n >= 3)"""


def _candidates(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(n % 7 == 0, None).otherwise(F.col("turn") + 10 + F.when(n % 11 == 0, 1).otherwise(0)).alias("value"))


@query(f"WITH {_RUNS} SELECT doc, run, page, value, n FROM r")
def folio_runs(spark, sf_dir):
    return trust.folio_runs(_candidates(spark, sf_dir))


@query(f"WITH {_RUNS}, m AS (SELECT *, max(n) OVER (PARTITION BY doc, value) AS most FROM r), s AS (SELECT *, count(*) FILTER (n = most) OVER (PARTITION BY doc, value) AS same FROM m) SELECT doc, page, value FROM s WHERE n = most AND same = 1")
def folio_verified(spark, sf_dir):
    return trust.verified_folios(_candidates(spark, sf_dir))


@query(f"""WITH {_RUNS}, p AS (SELECT doc, page, value - (turn + CASE WHEN length(text) % 5 = 0 THEN 9 ELSE 10 END) AS off FROM r JOIN conversations ON conv_id = doc AND turn = page),
k AS (SELECT doc, off, count(*) AS n, min(page) AS first FROM p GROUP BY ALL), t AS (SELECT doc, off, n, sum(n) OVER (PARTITION BY doc)::BIGINT AS samples, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first, off) AS x FROM k)
SELECT doc, CASE WHEN n >= samples * 0.9 AND off = 0 THEN 'identity' WHEN n >= samples * 0.9 THEN 'shift' ELSE 'divergent' END AS relation, CASE WHEN n >= samples * 0.9 THEN off END AS "offset", samples FROM t WHERE x = 1""")
def offset_mode(spark, sf_dir):
    labels = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (F.col("turn") + F.when(F.length("text") % 5 == 0, 9).otherwise(10)).cast("string").alias("label"))
    return trust.offset_relation(labels, trust.folio_runs(_candidates(spark, sf_dir)))


@query("""WITH l AS (SELECT conv_id AS doc, turn AS page, 'S' || (turn + CASE WHEN length(text) % 3 = 0 THEN -2 ELSE 1 END) AS label, turn + CASE WHEN length(text) % 3 = 0 THEN -2 ELSE 1 END AS v FROM conversations),
n AS (SELECT *, try_cast(regexp_extract(label, '([0-9]{1,4})', 1) AS INT) AS n FROM l), d AS (SELECT *, n < lag(n) OVER (PARTITION BY doc ORDER BY page) AS dr FROM n),
f AS (SELECT doc, count(*) AS a, count(DISTINCT label) AS u, count(n) AS c, count(*) FILTER (dr) AS drops FROM d GROUP BY doc)
SELECT doc, CASE WHEN u < a * 0.8 OR (c >= a * 0.8 AND c > 1 AND drops > greatest(1, floor(c / 50))) THEN 'physical_only' ELSE 'pdf_label_sane' END AS trust FROM f""")
def label_sanity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    labels = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.concat(F.lit("S"), F.col("turn") + F.when(F.length("text") % 3 == 0, -2).otherwise(1)).alias("label"))
    return trust.label_sanity(labels, c.groupBy(F.col("conv_id").alias("doc")).agg(F.count("*").alias("page_count")))


@query(f"""WITH {_RUNS}, h AS (SELECT doc, min(page) AS lo, max(page) AS hi FROM r GROUP BY doc), plan AS (SELECT doc, lo AS from_page, greatest(lo, hi - 1) AS to_page, lo + 10 AS start_label FROM h)
SELECT r.doc, count(plan.doc) AS covered, count(*) FILTER (start_label + page - from_page <> value) AS contradictions, count(*) FILTER (plan.doc IS NULL) AS outside FROM r LEFT JOIN plan ON plan.doc = r.doc AND page BETWEEN from_page AND to_page GROUP BY r.doc""")
def plan_coverage(spark, sf_dir):
    runs = trust.folio_runs(_candidates(spark, sf_dir))
    plan = runs.groupBy("doc").agg(F.min("page").alias("from_page"), F.greatest(F.min("page"), F.max("page") - 1).alias("to_page"), (F.min("page") + 10).alias("start_label"))
    return trust.plan_coverage(plan, runs)


@query("""SELECT o_orderkey, CASE WHEN o_totalprice % 7 < 1 THEN 'i' ELSE last_value(CASE WHEN o_totalprice % 7 < 1 THEN NULL END) OVER () END AS label FROM orders WHERE FALSE
UNION ALL SELECT o.o_orderkey, (SELECT arg_max(r.o_orderpriority, r.o_orderkey) FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'F' AND r.o_orderkey <= o.o_orderkey) FROM orders o""")
def label_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ranges = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("start"), F.col("o_orderpriority").alias("label"))
    return trust.label_in_effect(o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page")), ranges).select(F.col("page").alias("o_orderkey"), "label")


@query("""SELECT a.conv_id, a.turn, b.role AS "before", c.role AS "after" FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1""")
def neighbors_pm1(spark, sf_dir):
    return locate.neighbors(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "before", "after")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, chunk_index, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index) - length(text) - 1 AS o FROM lines),
n AS (SELECT doc_id, n_chars // 2 AS pos FROM documents)
SELECT n.doc_id, coalesce(max(chunk_index) FILTER (o <= pos AND chunk_index > 0)::VARCHAR, 'first') AS page FROM n JOIN b USING (doc_id) GROUP BY n.doc_id""")
def page_at(spark, sf_dir):
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    bounds = F.filter(F.transform(begins, lambda o, i: F.struct(o.alias("offset"), i.cast("string").alias("label"))), lambda b: (b["label"] != "0") & (b["label"] != F.size(sizes).cast("string")))
    docs = table(spark, sf_dir, "documents").withColumn("bounds", bounds)
    return docs.select("doc_id", locate.page_at(F.floor(F.col("n_chars") / 2), F.col("bounds"), F.lit("first")).alias("page"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'active' WHEN p_size > 5 THEN 'superseded' ELSE 'unknown' END AS state FROM part""")
def liveness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), "p_size")
    chunks = p.filter("p_size > 5").select("chunk_id", (F.col("p_size") > 25).cast("int").alias("snapshot_id"))
    snapshots = spark.range(2).select(F.col("id").cast("int").alias("snapshot_id"), (F.col("id") == 1).alias("active"))
    return locate.liveness(p.select("chunk_id"), chunks, snapshots).select(F.col("chunk_id").alias("p_partkey"), "state")


@query("""SELECT o_orderstatus, count(*) AS n, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3] AS first FROM orders GROUP BY o_orderstatus""")
def locator_stats(spark, sf_dir):
    return locate.counts_with_first(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderdate", "o_orderkey"], "o_orderkey", 3)


@query("""SELECT l_orderkey, l_linenumber, list_transform(range(0, greatest(l_quantity::INT, 1), greatest(1, 10 // greatest(1, (l_extendedprice::BIGINT // l_quantity::BIGINT) // 200))::INT), lambda s: s) AS starts FROM lineitem""")
def scan_batches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    price = F.floor(F.floor(F.round("l_extendedprice").cast("long") / F.col("l_quantity").cast("long")) / 200) * F.col("l_quantity").cast("long")
    return li.select("l_orderkey", "l_linenumber", trust.batch_starts(price, F.col("l_quantity").cast("int"), 10).alias("starts"))
