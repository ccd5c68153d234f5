"""Retrieval metrics over hits (query_id, id, rank) and gold (query_id, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import search


def per_query(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, p_at_k, hit_at_k, rr, recall_at_k); p_at_k divides by the smaller of k and the hits."""
    marked = hits.join(gold.select("query_id", "id", F.lit(1).alias("good")), ["query_id", "id"], "left")
    found = marked.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if((F.col("rank") <= k) & F.col("good").isNotNull()).alias("near"), F.min(F.when(F.col("good").isNotNull(), F.col("rank"))).alias("first"))
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    joined = found.join(sizes, "query_id", "left")
    return joined.select(
        "query_id",
        (F.col("near") / F.least(F.lit(k), F.col("n"))).alias("p_at_k"),
        (F.col("near") > 0).cast("int").alias("hit_at_k"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("near") / F.col("gold"), F.lit(0.0)).alias("recall_at_k"),
    )


def means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_at_k", "hit_at_k", "rr", "recall_at_k")], F.count("*").alias("queries"))


def nearest_rank(values: str, p: float) -> Column:
    """Nearest-rank percentile: the value at place ceil(p / 100 * n)."""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {values})")


def matrix_hits(arms: DataFrame, configs: DataFrame, docs: DataFrame, fetch: int, top_n: int = 10, cap: int = 2) -> DataFrame:
    """(config, query_id, id, rank, score): the hits of every configuration from arm results that are made once.

    ``arms``: arm (a name), place (its order), query_id, id, rank; ``configs``: config, arms (names), hygiene. A configuration fuses
    its arms and cuts to ``fetch``; with hygiene, front matter goes and an owner has at most ``cap`` hits first. ``docs``: id, owner, text.
    """
    chosen = arms.join(F.broadcast(configs.select("config", F.explode("arms").alias("arm"))), "arm")  # a few rows
    run = chosen.select(F.struct("config", "query_id").alias("query_id"), "id", F.col("place").alias("arm"), "rank")
    fused = search.fuse(run, fetch)
    clean = F.broadcast(configs.filter("hygiene").select("config"))
    by_config = fused.withColumn("config", F.col("query_id.config"))
    with_rules = by_config.join(clean, "config", "left_semi").select(*fused.columns)
    kept = search.cap_with_refill(search.drop_front_matter(with_rules, docs), docs.select("id", "owner"), cap)
    hits = by_config.join(clean, "config", "left_anti").select(*fused.columns).unionByName(kept)
    return hits.filter(F.col("rank") <= top_n).select("query_id.config", "query_id.query_id", "id", "rank", "score")


def query_records(hits: DataFrame, gold: DataFrame, queries: DataFrame, configs: DataFrame) -> DataFrame:
    """(config, query_id, top, first, p1, hit5, hit10, rr): a record a configuration and query, those without hits too; ``gold``: query_id, id."""
    marked = hits.join(gold.withColumn("good", F.lit(True)), ["query_id", "id"], "left")
    found = marked.groupBy("config", "query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("top"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(configs.select("config")))  # a row a configuration and query is the result
    within = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))
    joined = every.join(found, ["config", "query_id"], "left")
    ids = F.transform("top", lambda x: x["id"])
    return joined.select("config", "query_id", F.coalesce(ids, F.array().cast(f"array<{dict(hits.dtypes)['id']}>")).alias("top"), "first", within(1).alias("p1"), within(5).alias("hit5"), within(10).alias("hit10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def matrix_means(records: DataFrame) -> DataFrame:
    """(config, p1, hit5, mrr, hit10, queries)."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return records.groupBy("config").agg(mean("p1", "p1"), mean("hit5", "hit5"), mean("rr", "mrr"), mean("hit10", "hit10"), F.count("*").alias("queries"))


def write_report(records: DataFrame, folder: str) -> None:
    """The records as JSON lines below ``folder``/records and the table of means as Markdown in ``folder``/summary; one row a configuration is collected."""
    records.write.mode("overwrite").json(f"{folder}/records")
    rows = matrix_means(records).orderBy("config").collect()
    head = ["| configuration | P@1 | hit@5 | MRR | hit@10 | queries |", "|---|---|---|---|---|---|"]
    told = [f"| {r['config']} | {r['p1']:.3f} | {r['hit5']:.3f} | {r['mrr']:.3f} | {r['hit10']:.3f} | {r['queries']} |" for r in rows]
    text = "\n".join(["# Retrieval by configuration", "", *head, *told, "", "P@1, hit@5 and hit@10 are 1 if a gold row is among the first 1, 5 and 10; MRR is 1 / rank of the first gold row."])
    records.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
