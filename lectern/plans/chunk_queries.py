"""Chunking and streaming queries. The test documents have single line breaks, which stand for paragraph breaks here."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chunk, extract
from lectern.plans.library_queries import outbox_latest
from lectern.plans.registry import LINES, ORACLES, query, table
from lectern.streaming import bucket_index, debounce


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, chunk_index, trim(text) AS text FROM lines WHERE trim(text) <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INT AS seq, text FROM p""")
def paragraphs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunk.paragraphs(F.col("text"))).alias("seq", "text"))


@query(f"""WITH {LINES}, d AS (SELECT doc_id, list(trim(text) ORDER BY chunk_index) FILTER (trim(text) <> '') AS p FROM lines GROUP BY doc_id)
SELECT doc_id, s::INT AS start, len(p[s + 1:s + 5])::INT AS n, md5(array_to_string(p[s + 1:s + 5], chr(10))) AS digest FROM d, unnest(range(0, greatest(len(p) - 2, 1), 3)) t(s) WHERE len(p) > 0""")
def paragraph_windows(spark, sf_dir):
    p = _docs(spark, sf_dir).select("doc_id", chunk.paragraphs(F.col("text")).alias("p"))
    w = p.select("doc_id", F.posexplode(chunk.windows(F.col("p"), 5, 2)).alias("k", "w"))
    return w.select("doc_id", (F.col("k") * 3).alias("start"), F.size("w").alias("n"), F.md5(F.array_join("w", "\n")).alias("digest"))


@query()
def budget_chunks(spark, sf_dir):
    return chunk.chunk_table(_docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH RECURSIVE {LINES}, p AS (SELECT doc_id, trim(text) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k,
(len(list_filter(string_split_regex(text, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')) * 13 // 10)::BIGINT AS t FROM lines WHERE trim(text) <> ''),
f(doc_id, k, c, used) AS (SELECT doc_id, 1::BIGINT, 0, t FROM p WHERE k = 1 UNION ALL
SELECT p.doc_id, p.k, CASE WHEN used + t > 512 THEN c + 1 ELSE c END, CASE WHEN used + t > 512 THEN t ELSE used + t END FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1)
SELECT f.doc_id, c AS chunk_index, (min(f.k) - 1)::INT AS first_paragraph, (max(f.k) - 1)::INT AS last_paragraph, md5(string_agg(p.text, chr(10) || chr(10) ORDER BY f.k)) AS digest
FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k GROUP BY f.doc_id, c""")
def plain_chunks(spark, sf_dir):
    c = chunk.chunk_table(_docs(spark, sf_dir), "doc_id", "text", chunk.plain_chunks)
    return c.select("doc_id", "chunk_index", "first_paragraph", "last_paragraph", F.md5("text").alias("digest"))


@query("""SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+[.!?…]+'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 25 AND 600))::INT AS n FROM documents""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(extract.sentences(F.col("text"))).alias("n"))


@query(ORACLES["outbox_latest"])
def outbox_stream(spark, sf_dir):
    """The outbox drained by a stream gives what the batch gives."""
    run = bucket_index.shared_dir(spark, "outbox")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    index = bucket_index.BucketIndex(spark, f"{run}/index", "user_id", ["ts", "event_id"], 32)
    bucket_index.drain(events.withColumn("op", F.lit("upsert")), index, f"{run}/checkpoint").awaitTermination()
    return index.read().select(outbox_latest(spark, sf_dir).columns)


@query("""WITH b AS (SELECT *, event_id % 3 AS batch, CASE WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 7 = 0 THEN 'skip' ELSE 'upsert' END AS op FROM events)
SELECT user_id, event_id, event_type, value FROM (SELECT * FROM b WHERE op <> 'skip' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, ts DESC, event_id DESC) = 1) WHERE op = 'upsert'""")
def bucketed_index(spark, sf_dir):
    """Three batches with deletes and skips, the last one run twice; what no manifest names is removed."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 11 == 0, "delete").when(F.col("event_id") % 7 == 0, "skip").otherwise("upsert")
    index = bucket_index.BucketIndex(spark, bucket_index.shared_dir(spark, "index"), "user_id", ["ts", "event_id"], 32)
    for n in (0, 1, 2, 2):
        index.apply(e.filter(F.col("event_id") % 3 == n).withColumn("op", op), n)
    index.clean(1)
    return index.read().select("user_id", "event_id", "event_type", "value")


@query("""WITH e AS (SELECT event_type, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT event_type, ts, sum(brk) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
b AS (SELECT event_type, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS events FROM s GROUP BY event_type, k)
SELECT event_type, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(until, '%Y-%m-%d %H:%M:%S.%f') AS until, events FROM b WHERE until <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM events)""")
def debounced_runs(spark, sf_dir):
    """Bursts of events of a type, each run once when it has been quiet for half an hour; the stream is started twice."""
    run = bucket_index.shared_dir(spark, "debounce")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    held = debounce.Debounced(spark, f"{run}/ledger", lambda closed: None)
    for _ in range(2):
        held.start(events, "ts", "event_type", "30 minutes", "2 days", f"{run}/checkpoint").awaitTermination()
    told = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    ran = held.runs()
    if ran is None:  # events so dense that no session closes
        ran = spark.createDataFrame([], "event_type string, first timestamp, until timestamp, events long")
    return ran.select("event_type", told("first"), told("until"), "events")
