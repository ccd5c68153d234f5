"""Retrieval queries: benchmark items ask the documents; every hundredth vector asks all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluate, search
from lectern.plans.registry import query, table

TOP = 10


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), "text")


_BAG = "list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
ARMS = f"""
bag AS (SELECT doc_id AS id, {_BAG} AS b FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(b)) AS mean FROM bag),
tok AS (SELECT id, len(b) AS length, unnest(b) AS term FROM bag),
post AS (SELECT id, term, any_value(length) AS length, count(*) AS tf FROM tok GROUP BY id, term),
ask AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_BAG}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm_s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
         FROM ask JOIN df USING (term) JOIN post USING (term) CROSS JOIN corpus GROUP BY query_id, id),
bm AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, score FROM bm_s),
ask64 AS (SELECT query_id, term FROM ask QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY qtf DESC, term) <= 64),
sp_s AS (SELECT query_id, id, round(sum(tf * 0.5 / (tf * 0.5 + 1.0)), 6) AS score FROM ask64 JOIN post USING (term) GROUP BY query_id, id),
sp AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, score FROM sp_s),
both_arms AS (SELECT *, 0 AS arm FROM bm WHERE rank <= 30 UNION ALL SELECT *, 1 FROM sp WHERE rank <= 30),
fused AS (SELECT query_id, id, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (arm = 0), 0.0::DOUBLE) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (arm = 1), 0.0::DOUBLE) AS score,
          min(arm * 1000 + rank) AS seen FROM both_arms GROUP BY query_id, id),
rrf AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id)::INT AS rank FROM fused),
capped AS (SELECT query_id, id, score, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS spare FROM rrf JOIN documents ON doc_id = id),
cut_capped AS (SELECT query_id, id, score, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS spare FROM rrf JOIN documents ON doc_id = id WHERE rank <= 30),
cut_spread AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY spare, rank)::INT AS rank FROM cut_capped),
spread AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY spare, rank)::INT AS rank FROM capped)"""


@query(f"WITH {ARMS} SELECT query_id, id, rank, score FROM bm WHERE rank <= {TOP}")
def bm25_topk(spark, sf_dir):
    return search.bm25(_queries(spark, sf_dir), _docs(spark, sf_dir), TOP)


@query(f"WITH {ARMS} SELECT query_id, id, rank, score FROM sp WHERE rank <= {TOP}")
def sparse_topk(spark, sf_dir):
    return search.sparse_by_counts(_queries(spark, sf_dir), _docs(spark, sf_dir), TOP)


def _fused(spark, sf_dir):
    q, d = _queries(spark, sf_dir), _docs(spark, sf_dir)
    n = search.fetch_count(TOP)
    return search.fuse(search.lexical_arms(q, d, n))


@query(f"WITH {ARMS} SELECT query_id, id, rank, round(score, 9) AS score FROM rrf")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"WITH {ARMS} SELECT query_id, id, rank, round(score, 9) AS score FROM spread")
def diversify(spark, sf_dir):
    return search.cap_with_refill(_fused(spark, sf_dir), _docs(spark, sf_dir).select("id", "owner"), 2).withColumn("score", F.round("score", 9))


@query(f"WITH {ARMS} SELECT query_id, id, rank, round(score, 9) AS score FROM cut_spread WHERE rank <= {TOP}")
def hybrid_search(spark, sf_dir):
    """No document of the test tables is front matter, so the filter between fusion and cap leaves all. Its SQL folds no near copies."""
    return search.hybrid(_queries(spark, sf_dir), _docs(spark, sf_dir), TOP, fold=False).withColumn("score", F.round("score", 9))


@query()
def hybrid_search_folded(spark, sf_dir):
    """``hybrid_search`` with near copies of one owner folded before the cap."""
    return search.hybrid(_queries(spark, sf_dir), _docs(spark, sf_dir), TOP).withColumn("score", F.round("score", 9))


_SET = "list_distinct(list_filter(string_split_regex(lower(text), '[\\x09-\\x0D\\x20]+'), lambda x: x <> ''))"


@query(f"""WITH {ARMS}, c AS (SELECT query_id, id, rank FROM bm WHERE rank <= 30),
j AS (SELECT c.query_id, c.id, c.rank, round(len(list_intersect(q.s, d.s)) / (len(q.s) + len(d.s) - len(list_intersect(q.s, d.s))), 6) AS score
      FROM c JOIN (SELECT item_id, {_SET} AS s FROM benchmark) q ON q.item_id = c.query_id JOIN (SELECT doc_id, {_SET} AS s FROM documents) d ON d.doc_id = c.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS rank, score FROM j""")
def rerank_jaccard(spark, sf_dir):
    q, d = _queries(spark, sf_dir), _docs(spark, sf_dir)
    hits = search.bm25(q, d, 30)
    return search.rerank(hits, search.jaccard_scores(hits, q, d))


@query()
def near_dup_fold(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return search.fold_near_duplicates(search.bm25(_queries(spark, sf_dir), d, 30), d)


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("asked")), v


KNN = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, q.label AS asked, r.label AS label, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM e q, e r WHERE q.vec_id % 100 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)"""


@query(f"WITH {KNN} SELECT query_id, id, rank, score FROM knn WHERE rank <= {TOP}")
def knn_topk(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return search.knn(q.select("query_id", "vector"), v.select("id", "vector"), TOP)


@query(f"WITH {KNN} SELECT query_id, id, rank, score FROM knn WHERE rank <= {TOP} AND label = asked")
def knn_post_filter(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    hits = knn_topk(spark, sf_dir)
    scope = hits.join(v.select("id", "label"), "id").join(q.select("query_id", "asked"), "query_id").filter("label = asked").select("query_id", "id")
    return search.keep_scope(hits, scope)


@query(f"""WITH {KNN}, h AS (SELECT * FROM knn WHERE rank <= {TOP}),
g AS (SELECT q.vec_id AS query_id, count(*) AS gold FROM e q JOIN e r ON q.label = r.label WHERE q.vec_id % 100 = 0 GROUP BY 1),
m AS (SELECT query_id, count(*) AS n, count(*) FILTER (label = asked AND rank <= 5) AS near, min(rank) FILTER (label = asked) AS first FROM h GROUP BY 1)
SELECT query_id, near / least(5, n) AS p_at_k, (near > 0)::INT AS hit_at_k, coalesce(1.0 / first, 0.0)::DOUBLE AS rr, coalesce(near / gold, 0.0)::DOUBLE AS recall_at_k FROM m LEFT JOIN g USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    gold = q.join(v, q["asked"] == v["label"]).select("query_id", "id")
    return evaluate.per_query(knn_topk(spark, sf_dir), gold, 5)


@query(f"""WITH {KNN}, h AS (SELECT * FROM knn WHERE rank <= {TOP}),
g AS (SELECT q.vec_id AS query_id, count(*) AS gold FROM e q JOIN e r ON q.label = r.label WHERE q.vec_id % 100 = 0 GROUP BY 1),
m AS (SELECT query_id, count(*) AS n, count(*) FILTER (label = asked AND rank <= 5) AS near, min(rank) FILTER (label = asked) AS first FROM h GROUP BY 1)
SELECT round(avg(near / least(5, n)), 6) AS p_at_k, round(avg((near > 0)::INT), 6) AS hit_at_k, round(avg(coalesce(1.0 / first, 0.0)::DOUBLE), 6) AS rr,
round(avg(near / gold), 6) AS recall_at_k, count(*) AS queries FROM m LEFT JOIN g USING (query_id)""")
def retrieval_means(spark, sf_dir):
    return evaluate.means(retrieval_metrics(spark, sf_dir))


@query("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_pct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluate.nearest_rank("value", 50).alias("p50"), evaluate.nearest_rank("value", 95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {ARMS}, cfg(config, arms, hygiene) AS (VALUES ('bm25', [0], false), ('both', [0, 1], false), ('both_hygiene', [0, 1], true), ('sparse', [1], false)),
f0 AS (SELECT config, hygiene, query_id, id, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (arm = 0), 0.0::DOUBLE) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (arm = 1), 0.0::DOUBLE) AS score,
       min(arm * 1000 + rank) AS seen FROM cfg JOIN both_arms ON list_contains(arms, arm) GROUP BY ALL),
f1 AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, seen, id) AS place FROM f0),
f2 AS (SELECT f1.*, source, row_number() OVER (PARTITION BY config, query_id, source ORDER BY place) > 2 AND hygiene AS spare FROM f1 JOIN documents ON doc_id = id WHERE place <= 30),
f3 AS (SELECT config, query_id, id, row_number() OVER (PARTITION BY config, query_id ORDER BY spare, place) AS rank FROM f2 QUALIFY rank <= 10),
m AS (SELECT config, query_id, min(rank) FILTER (id % 7 = query_id % 7) AS first FROM f3 GROUP BY config, query_id),
e AS (SELECT config, item_id, first FROM cfg CROSS JOIN benchmark LEFT JOIN m USING (config) WHERE m.query_id = item_id
      UNION ALL SELECT config, item_id, NULL FROM cfg CROSS JOIN benchmark WHERE (config, item_id) NOT IN (SELECT config, query_id FROM m))
SELECT config, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS p1, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)), 6) AS mrr,
round(avg(coalesce((first <= 10)::INT, 0)), 6) AS hit10, count(*) AS queries FROM e GROUP BY config""")
def retrieval_matrix(spark, sf_dir):
    """Four configurations over all benchmark items; documents whose id has an item's remainder by 7 stand for its gold."""
    q, d = _queries(spark, sf_dir), _docs(spark, sf_dir)
    n = search.fetch_count(TOP)
    names = F.array(F.lit("bm25"), F.lit("sparse"))
    arms = search.lexical_arms(q, d, n).select(names[F.col("arm")].alias("arm"), F.col("arm").alias("place"), "query_id", "id", "rank")
    configs = spark.sql("SELECT * FROM VALUES ('bm25', array('bm25'), false), ('sparse', array('sparse'), false), ('both', array('bm25', 'sparse'), false), ('both_hygiene', array('bm25', 'sparse'), true) AS t(config, arms, hygiene)")
    hits = evaluate.matrix_hits(arms, configs, d, n, TOP)
    pairs = hits.select("query_id", "id").distinct().filter(F.col("id") % 7 == F.col("query_id") % 7)
    return evaluate.matrix_means(evaluate.query_records(hits, pairs, q, configs))
