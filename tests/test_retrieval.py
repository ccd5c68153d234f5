"""Scan-side recall against joins, hybrid search at its edges, altered quotes against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import quotes, recall, search


def found(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the"] * 40
    docs = [(i, f"o{i % 7}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300 + i, "o1", "the w1 w2 w3") for i in range(30)] + [(400, None, None)]
    asks = [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [("blank", "  "), ("null", None), ("strange", "nowhere")]
    return spark.createDataFrame(asks, "query_id string, text string"), spark.createDataFrame(docs, "id long, owner string, text string").repartition(5)


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_scan_equals_joins(spark, corpus, cells, monkeypatch):
    monkeypatch.setattr(recall, "CELLS", cells)
    asks, docs = corpus
    for k in (1, 7, 500):
        assert found(search.bm25(asks, docs, k)) == found(search.bm25_joined(asks, docs, k))
        assert found(search.sparse_by_counts(asks, docs, k, most_terms=3)) == found(search.sparse_joined(asks, docs, k, most_terms=3))
    both = search.lexical_arms(asks, docs, 5)
    assert found(both.filter("arm = 0").drop("arm")) == found(search.bm25_joined(asks, docs, 5)) and found(both.filter("arm = 1").drop("arm")) == found(search.sparse_joined(asks, docs, 5))
    assert found(search.bm25(asks, docs.limit(0), 5)) == [] == found(search.bm25(asks.limit(0), docs, 5))


def test_too_many_queries_join(spark, corpus, monkeypatch):
    asks, docs = corpus
    want = found(search.lexical_arms(asks, docs, 5))
    monkeypatch.setattr(recall, "MOST_BYTES", 64)
    assert recall.asked_terms(asks.select("query_id", search.terms(F.col("text")).alias("bag")), 64) is None
    assert found(search.lexical_arms(asks, docs, 5).select("arm", "query_id", "id", "rank", "score")) == want


def test_frequent_terms_do_not_shuffle(spark, corpus):
    """No exchange below the scoring: only each task's best hits move."""
    asks, docs = corpus
    plan = search.bm25(asks, docs.coalesce(1), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_knn_scan_equals_blocks(spark, kind, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)]) for i in range(200)] + [(900, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("id", F.col("id").cast(kind)).repartition(4)
    asks = df.filter("cast(id as long) % 20 = 0").withColumnRenamed("id", "query_id")
    want = found(search.knn_in_blocks(asks, df, 6, 16, 3))
    assert found(search.knn(asks, df, 6)) == want
    odd = df.unionByName(spark.createDataFrame([("950", None), ("951", [1.0])], "id string, vector array<double>").withColumn("id", F.col("id").cast(kind)))
    assert found(search.knn(asks, odd, 6)) == want
    monkeypatch.setattr(recall, "MOST_BYTES", 64)
    assert found(search.knn(asks, df, 6, 16, 3)) == want


def test_hybrid_edges(spark, corpus):
    asks, docs = corpus
    vectors = docs.select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(7)).cast("double") for k in range(3)]).alias("vector"))
    qv = asks.select("query_id", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("vector"))
    seen = []

    def scores(hits):
        seen.append(hits.groupBy("query_id").count().agg(F.max("count")).first()[0])
        return hits.select("query_id", "id", (-F.col("id")).cast("double").alias("rerank"))

    out = search.hybrid(asks, docs, 30, query_vectors=qv, row_vectors=vectors, rerank_scores=scores)
    assert seen == [search.MOST] and out.groupBy("query_id").count().agg(F.max("count")).first()[0] == 30
    assert out.filter("query_id IN ('blank', 'null')").count() == 0
    by_default = search.hybrid(asks, docs, 0)
    assert found(by_default) == found(search.hybrid(asks, docs, 10)) != []
    with pytest.raises(ValueError):
        search.hybrid(asks, docs, 65)
    with pytest.raises(ValueError):
        search.hybrid(asks, docs, arms=())
    assert found(search.hybrid(asks, docs, 5, fold=False, cap=99, arms=("bm25",)).drop("score")) == found(search.bm25(asks.filter("trim(text) <> ''"), docs, 15).filter("rank <= 5").drop("score"))


# altered quotes

def bare(word):
    return re.sub(r"[^\w]|_", "", word.replace("ß", "ss").replace("ﬁ", "fi").replace("ﬂ", "fl")).lower()


def forms(text):
    return [b for b in map(bare, re.split(r"[\x20\x09-\x0d]+", text or "")) if b]


def plain_search(quote, hint, pages):
    """Ladder, proof and fallback over every page in turn."""
    words = forms(quote)
    windows = []
    for step, (low, high, least) in enumerate(quotes.LADDER):
        cut = words[low if low >= 0 else len(words) + low : len(words) if high is None else high if high >= 0 else len(words) + high]
        if len(words) >= least and len(" ".join(cut)) >= 12:
            windows.append((step, cut))
    core = [w for w in words if len(w) > 3][:14]

    def best(pool):
        top = min(pool, key=lambda p: (p[0] != hint, -len(p[1]), p[0]))
        return top[0], len(pool)

    first = None
    for step, cut in windows:
        pool = [(p, t) for p, t in pages if any(forms(t)[i : i + len(cut)] == cut for i in range(len(forms(t))))]
        proven = [(p, t) for p, t in pool if len(core) >= 4 and sum(w in "".join(forms(t)) for w in core) >= max(4, int(len(core) * 0.7))]
        if proven:
            return (*best(proven), step, True)
        if pool and first is None:
            first = (*best(pool), step, False)
    if first:
        return first
    for step, cut in windows:
        pool = [(p, t) for p, t in pages if len("".join(cut)) >= 14 and "".join(cut) in "".join(forms(t))]
        if pool:
            return (*best(pool), step + 9, False)
    return None, None, None, None


def test_altered_quotes(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("Wald", "stein", "über", "ro") for b in ("haus", "ße", "n") for c in ("", "berg", "-tal", ".")]
    books = {d: [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(8)] for d in range(30)}
    made = []
    for d, pages in books.items():
        pages[6] = pages[2]  # a page printed twice
        pages[7] = pages[3][:60]
        for k in range(5):
            w = rng.choice(pages).split(" ")
            at = rng.randrange(max(1, len(w) - 10))
            w = w[at : at + rng.randint(1, 14)]
            if k == 1 and len(w) > 4:
                del w[rng.randrange(len(w))]
            made.append((f"{d}/{k}", d, {0: " ", 1: " ", 2: "\n", 3: " – ", 4: " "}[k].join(w).upper() if k == 4 else {0: " ", 1: " ", 2: "\n", 3: " – "}[k].join(w), rng.choice([None, 6, 2])))
        if d % 4 == 0:
            pages[:] = [p.replace(" ", "\x02") for p in pages]
    made += [("none", 99, "a book that is not there at all", None), ("null", 1, None, None), ("empty", 1, "  ", 3)]
    made = [(q, d, t.replace("SSE", "ße").replace("ẞ", "ß") if t else t, h) for q, d, t, h in made]
    asked = spark.createDataFrame(made, "quote_id string, doc int, quote string, hint int")
    pages = spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)] + [(1, 50, None)], "doc int, page int, text string")
    out = {r["quote_id"]: r for r in quotes.locate_quotes(asked, pages).collect()}
    assert len(out) == len(made)
    for q, d, text, hint in made:
        r = out[q]
        want = plain_search(text, hint, list(enumerate(books.get(d, []))))
        assert (r["page"], r["hits"], r["step"], r["proven"]) == want, (q, text)
        if r["page"] is not None:
            page, low, words = books[d][r["page"]], quotes.LADDER[r["step"] % 9], forms(text)
            cut = "".join(words[low[0] if low[0] >= 0 else len(words) + low[0] : len(words) if low[1] is None else low[1] if low[1] >= 0 else len(words) + low[1]])
            assert "".join(forms(page[r["place"] :])).startswith(cut)
    assert sum(r["step"] is not None and r["step"] >= 9 for r in out.values()) > 5 and sum(bool(r["proven"]) for r in out.values()) > 40
