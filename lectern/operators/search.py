"""Ranked recall and fusion: BM25, exact kNN, learned-sparse, reciprocal rank fusion, reranking, hygiene.

Arms score in the scan while the queries are few enough to be sent to every task (``recall``); beyond that, BM25 and sparse
join postings, and vectors meet in blocks. Hits are rows (query_id, id, rank, score); rank starts at 1 and every order ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import frontmatter
from lectern.functions.text import jaccard, token_set, words
from lectern.operators import recall

K1, B = 1.2, 0.75
RRF = 60
OVERFETCH, MOST, TOP_N = 3, 64, 10
Arm = Callable[[DataFrame], DataFrame]


def terms(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits or of characters from U+0080 on, repeats included."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), lambda x: x != "")


def top_k(scored: DataFrame, k: int, places: int = 6, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, id, rank, score): the best k of each query by rounded score, then by id."""
    scored = scored.withColumn("score", F.round("score", places))
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*by, "id", "rank", "score")


def fetch_count(top_n: int) -> int:
    """How many candidates an arm gives for ``top_n`` wanted; 10 if none is given, an error above MOST."""
    top_n = top_n if top_n > 0 else TOP_N
    if top_n > MOST:
        raise ValueError(f"top_n is at most {MOST}")
    return min(OVERFETCH * top_n, MOST)


def _postings(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct query terms, and (id, term, tf, length) of documents that hold one: nothing else of them shuffles."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    bag = docs.select("id", terms(F.col("text")).alias("bag"))
    held = bag.select("id", F.size("bag").alias("length"), F.explode("bag").alias("term"))
    known = asked.select("term").distinct()
    return asked, held.join(known, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def lexical_arms(queries: DataFrame, docs: DataFrame, k: int, arms: tuple[str, ...] = ("bm25", "sparse"), k1: float = K1, b: float = B, pivot: float = 1.0, most_terms: int = 64) -> DataFrame:
    """(arm, query_id, id, rank, score) of the named arms, counted from 0, from one scan; ``queries``: query_id, text; ``docs``: id, text.

    A document's terms are made once for both arms. A document without text has no terms and counts as one of length 0.
    """
    asked = recall.asked_terms(queries.select("query_id", terms(F.col("text")).alias("bag")), most_terms)
    if asked is None:
        joined = {"bm25": lambda: bm25_joined(queries, docs, k, k1, b), "sparse": lambda: sparse_joined(queries, docs, k, pivot, most_terms)}
        found = [joined[a]().withColumn("arm", F.lit(i)) for i, a in enumerate(arms)]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])
    bags = docs.select("id", terms(F.col("text")).alias("bag"))
    return top_k(recall.lexical(asked, queries, bags, k, k1, b, pivot, arms), k, by=("arm", "query_id"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Inverse frequency ln(1 + (N - df + 0.5) / (df + 0.5)), saturation tf / (tf + norm)."""
    return lexical_arms(queries, docs, k, ("bm25",), k1, b).drop("arm")


def sparse_by_counts(queries: DataFrame, docs: DataFrame, k: int, pivot: float = 1.0, most_terms: int = 64) -> DataFrame:
    """``sparse`` with the stand-in's weights (half a term's count), without a map a document."""
    return lexical_arms(queries, docs, k, ("sparse",), pivot=pivot, most_terms=most_terms).drop("arm")


def bm25_joined(queries: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` for queries of any number: their terms join the postings."""
    asked, postings = _postings(queries, docs)
    corpus = docs.select(F.coalesce(F.size(terms(F.col("text"))), F.lit(0)).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = asked.join(frequency, "term").join(postings, "term").crossJoin(F.broadcast(corpus))  # corpus: one row
    return top_k(scored.groupBy("query_id", "id").agg(F.sum(weight).alias("score")), k)


def sparse(queries: DataFrame, docs: DataFrame, k: int, pivot: float = 1.0, most_terms: int = 64) -> DataFrame:
    """``queries``/``docs``: (query_)id, weights map. The query's heaviest terms pick; each gives w / (w + pivot) of the document's weight."""
    asked = queries.select("query_id", F.explode("weights").alias("term", "w")).filter("w > 0")
    order = W.partitionBy("query_id").orderBy(F.desc("w"), "term")
    asked = asked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most_terms).select("query_id", "term")
    held = docs.select("id", F.explode("weights").alias("term", "w"))
    scored = asked.join(held, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") / (F.col("w") + pivot)).alias("score"))
    return top_k(scored, k)


def count_weights(c: Column) -> Column:
    """A deterministic stand-in for a sparse model: half a term's count."""
    bag = terms(c)
    return F.map_from_entries(F.transform(F.array_distinct(bag), lambda t: F.struct(t, F.size(F.filter(bag, lambda x: x == t)) * 0.5)))


def sparse_joined(queries: DataFrame, docs: DataFrame, k: int, pivot: float = 1.0, most_terms: int = 64) -> DataFrame:
    """``sparse_by_counts`` for queries of any number: their terms join the postings."""
    counted = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg((F.count("*") * 0.5).alias("w"))
    order = W.partitionBy("query_id").orderBy(F.desc("w"), "term")
    asked = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most_terms).select("query_id", "term")
    _, postings = _postings(queries, docs)
    w = F.col("tf") * 0.5
    return top_k(asked.join(postings, "term").groupBy("query_id", "id").agg(F.sum(w / (w + pivot)).alias("score")), k)


def knn(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096, query_block: int = 256) -> DataFrame:
    """Exact cosine top k; ``queries``: query_id, vector; ``rows``: id, vector. Zero vectors match nothing. The blocks are for queries beyond a scan."""
    found = recall.nearest(queries, rows, k)
    return top_k(found, k) if found is not None else knn_in_blocks(queries, rows, k, block, query_block)


def knn_in_blocks(queries: DataFrame, rows: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """``knn`` for queries of any number: blocks of queries meet blocks of rows, each meeting returns k rows a query."""
    n_rows, n_queries = rows.count(), queries.count()
    packed_rows = _blocks(rows, "id", max(1, -(-n_rows // block)))
    packed_queries = _blocks(queries.withColumnRenamed("query_id", "id"), "id", max(1, -(-n_queries // query_block))).toDF("qblk", "query_ids", "query_vectors")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, r in frame.iterrows():
                a, b = _unit(r["query_vectors"]), _unit(r["vectors"])
                ids, qids = np.asarray(r["ids"]), np.asarray(r["query_ids"])
                scores = np.round(a @ b.T, 6)
                for i, q in enumerate(qids):
                    order = np.lexsort((ids, -np.where(np.isnan(scores[i]), -np.inf, scores[i])))[:k]
                    order = order[~np.isnan(scores[i][order])]
                    yield pd.DataFrame({"query_id": q, "id": ids[order], "score": scores[i][order]})

    pairs = packed_rows.crossJoin(packed_queries)  # blocks, not rows
    kind = dict(rows.dtypes)["id"]
    found = pairs.mapInPandas(meet, f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double")
    return top_k(found, k)


def _blocks(df: DataFrame, key: str, n: int) -> DataFrame:
    dealt = df.withColumn("blk", F.pmod(F.xxhash64(key), F.lit(n)))
    return dealt.groupBy("blk").agg(F.collect_list(key).alias("ids"), F.collect_list("vector").alias("vectors"))


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def keep_scope(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Filter after the top k: hits whose (query_id, id) is in ``scope``; there may be fewer than k."""
    return hits.join(scope, ["query_id", "id"], "left_semi")


def rrf(arms: list[DataFrame], top_n: int | None = None, constant: int = RRF) -> DataFrame:
    """Fuse arms of hits: sum of 1 / (constant + rank) in arm order; ties keep the first arm's order."""
    all_hits = arms[0].withColumn("arm", F.lit(0))
    for i, arm in enumerate(arms[1:], 1):
        all_hits = all_hits.unionByName(arm.withColumn("arm", F.lit(i)))
    return fuse(all_hits, top_n, constant)


def fuse(hits: DataFrame, top_n: int | None = None, constant: int = RRF) -> DataFrame:
    """``rrf`` of hits that say their ``arm``."""
    terms_ = F.transform(F.sort_array(F.collect_list(F.struct("arm", "rank"))), lambda x: 1.0 / (constant + x["rank"]))
    fused = hits.groupBy("query_id", "id").agg(F.aggregate(terms_, F.lit(0.0), lambda a, x: a + x).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "seen", "id")
    out = fused.withColumn("rank", F.row_number().over(order))
    if top_n is not None:
        out = out.filter(F.col("rank") <= top_n)
    return out.select("query_id", "id", "rank", "score")


def drop_front_matter(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Without front matter, unless a query's hits are nothing else; ranks close up."""
    flagged = hits.join(docs.select("id", frontmatter.is_front_matter(F.col("text")).alias("front")), "id", "left")
    q = W.partitionBy("query_id")
    kept = flagged.withColumn("body", F.count_if(~F.coalesce("front", F.lit(False))).over(q)).filter(~F.coalesce("front", F.lit(False)) | (F.col("body") == 0))
    return kept.withColumn("rank", F.row_number().over(q.orderBy("rank"))).select("query_id", "id", "rank", "score")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Reorder by ``scores`` (query_id, id, rerank); a query whose scores don't cover its hits exactly keeps its order."""
    joined = hits.join(scores, ["query_id", "id"], "left")
    q = W.partitionBy("query_id")
    whole = F.min(F.col("rerank").isNotNull()).over(q)
    order = q.orderBy(F.desc(F.when(whole, F.col("rerank"))), F.col("rank"))
    return joined.withColumn("whole", whole).withColumn("new", F.row_number().over(order)).select("query_id", "id", F.col("new").alias("rank"), F.when(F.col("whole"), F.col("rerank")).otherwise(F.col("score")).alias("score"))


def jaccard_scores(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """A deterministic stand-in for a reranker: Jaccard of the sets of lower-case words, six places."""
    bag = F.array_distinct(words(F.lower("text")))
    named = hits.join(queries.select("query_id", bag.alias("a")), "query_id").join(docs.select("id", bag.alias("b")), "id")
    return named.select("query_id", "id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("rerank"))


def cap_with_refill(hits: DataFrame, owner: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` hits of each owner in order, then the others in order; ``owner``: id, owner."""
    own = hits.join(owner, "id", "left")
    rn = F.row_number().over(W.partitionBy("query_id", "owner").orderBy("rank"))
    order = W.partitionBy("query_id").orderBy("spare", "rank")
    return own.withColumn("spare", rn > cap).withColumn("new", F.row_number().over(order)).select("query_id", "id", F.col("new").alias("rank"), "score")


def fold_near_duplicates(hits: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Greedy in rank order: a hit folds into the first kept hit of its owner that is equal or more similar than the threshold.

    ``docs``: id, owner, text. A query has at most MOST hits an arm, so one query is one bounded group. Adds ``folded``.
    """
    full = hits.join(docs.select("id", "owner", token_set(F.coalesce("text", F.lit(""))).alias("tokens"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "id")
    id_type, query_type = dict(hits.dtypes)["id"], dict(hits.dtypes)["query_id"]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for r in frame.sort_values("rank").itertuples():
            tokens = set(r.tokens)
            for k in kept:
                union = len(tokens | k[2])
                if k[1] == r.owner and (k[0].digest == r.digest or union and len(tokens & k[2]) / union > threshold):
                    k[3] += 1
                    break
            else:
                kept.append([r, r.owner, tokens, 0])
        return pd.DataFrame({"query_id": [k[0].query_id for k in kept], "id": [k[0].id for k in kept], "rank": range(1, len(kept) + 1), "score": [k[0].score for k in kept], "folded": [k[3] for k in kept]})

    return full.groupBy("query_id").applyInPandas(fold, f"query_id {query_type}, id {id_type}, rank int, score double, folded int")


def hybrid(
    queries: DataFrame, docs: DataFrame, top_n: int = 10, cap: int = 2, query_vectors: DataFrame | None = None, row_vectors: DataFrame | None = None,
    graph_arm: Arm | None = None, rerank_scores: Arm | None = None, fold: bool = True, arms: tuple[str, ...] = ("bm25", "sparse"),
) -> DataFrame:
    """Dense, BM25, sparse and graph arms, fused and cut to what an arm fetches; front matter out; reranked; near copies folded; at most
    ``cap`` hits an owner first; ``top_n`` hits a query (10 if it is not positive, an error above MOST).

    ``queries``: query_id, text; ``docs``: id, owner, text. A blank query has no hits. ``arms`` names the lexical arms that run, none, one or
    both. The dense arm needs ``query_vectors`` (query_id, vector) and ``row_vectors`` (id, vector). ``graph_arm`` makes hits
    from the fused top (query_id, chunk_id), ``rerank_scores`` makes (query_id, id, rerank) from the hits. ``fold`` is off only
    where a query's SQL has no fold.
    """
    top_n = top_n if top_n > 0 else TOP_N
    n = fetch_count(top_n)
    if (query_vectors is None) != (row_vectors is None):
        raise ValueError("the dense arm needs vectors of queries and of rows")
    if not arms and query_vectors is None:
        raise ValueError("at least one arm must run")
    queries = queries.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    found = []
    if query_vectors is not None:
        asked = query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
        found.append(knn(asked, row_vectors.join(docs.select("id"), "id", "left_semi"), n).withColumn("arm", F.lit(0)))
    if arms:
        found.append(lexical_arms(queries, docs, n, arms).withColumn("arm", F.col("arm") + 1))
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    fused = fuse(hits, n)
    if graph_arm is not None:
        seeds = fused.filter(F.col("rank") <= top_n).select("query_id", F.col("id").alias("chunk_id"))
        linked = graph_arm(seeds).join(docs.select("id"), "id", "left_semi").filter(F.col("rank") <= n)
        fused = fuse(hits.unionByName(linked.select("query_id", "id", "rank", F.col("links").cast("double").alias("score"), F.lit(9).alias("arm"))), n)
    hits = drop_front_matter(fused, docs)
    if rerank_scores is not None:
        hits = rerank(hits, rerank_scores(hits))
    if fold:
        hits = fold_near_duplicates(hits, docs).drop("folded")
    return cap_with_refill(hits, docs.select("id", "owner"), cap).filter(F.col("rank") <= top_n)
