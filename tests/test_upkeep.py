"""What is kept over runs: the bucketed index, merged archives; and chapters that printed numbers confirm."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, trust
from lectern.streaming import bucket_index


def found(df):
    return sorted(map(str, df.collect()))


# bucketed index

def batch(spark, rows):
    return spark.createDataFrame(rows, "key int, at int, value string, op string")


def plain(batches):
    held = {}
    for rows in batches:
        last = {}
        for key, at, value, op in rows:
            if op != "skip":
                last[key] = max(last.get(key, (-1,)), (at, op, value))
        for key, (at, op, value) in last.items():
            held.pop(key, None)
            if op == "upsert":
                held[key] = (key, at, value)
    return sorted(map(str, held.values()))


def test_index_rewrites_touched_buckets_only(spark, tmp_path):
    index = bucket_index.BucketIndex(spark, str(tmp_path / "index"), "key", ["at"], 50)
    assert index.read() is None and index.manifest() == {}
    batches = [[(k, 0, f"a{k}", "upsert") for k in range(2000)], [(k, 1, f"b{k}", "upsert") for k in range(0, 2000, 100)]]
    for n, rows in enumerate(batches):
        index.apply(batch(spark, rows), n)
    files = lambda v: {os.path.dirname(p) for p in glob.glob(f"{tmp_path}/index/data/v={v}/bucket=*/*.parquet")}
    assert len(files(0)) == 50 and 0 < len(files(1)) <= 20
    assert sorted(str(tuple(r)) for r in index.read().select("key", "at", "value").collect()) == plain(batches)
    assert sum(v == 1 for v in index.manifest().values()) == len(files(1)) and set(index.manifest(0).values()) == {0}


def test_index_random_batches_restart_and_clean(spark, tmp_path):
    rng = random.Random(7)
    index = bucket_index.BucketIndex(spark, str(tmp_path / "index"), "key", ["at"], 8)
    batches = [[(rng.randrange(30), rng.randrange(5), rng.choice("xyz"), rng.choice(["upsert", "upsert", "delete", "skip"])) for _ in range(40)] for _ in range(4)] + [[]]
    rows = lambda: sorted(str(tuple(r)) for r in index.read().select("key", "at", "value").collect())
    for n, b in enumerate(batches):
        index.apply(batch(spark, b), n)
        if n == 1:  # a run that broke off before its manifest: its files are there, its commit isn't
            os.remove(f"{tmp_path}/index/manifest/v=1/_SUCCESS")
            assert index.versions() == [0] and rows() == plain(batches[:1])
            index.apply(batch(spark, b), n)
        index.apply(batch(spark, batches[0]), n)  # again: nothing happens
        assert rows() == plain(batches[: n + 1])
    before = len(glob.glob(f"{tmp_path}/index/data/v=*/bucket=*"))
    assert index.clean(1) > 0 and rows() == plain(batches)
    assert len(glob.glob(f"{tmp_path}/index/data/v=*/bucket=*")) < before and index.clean(1) == 0
    index.apply(batch(spark, [(k, 9, "", "delete") for k in range(30)]), len(batches))
    assert index.read() is None


def test_index_by_stream(spark, tmp_path):
    rng = random.Random(9)
    batches = [[(rng.randrange(20), 10 * n + k, f"v{k}", rng.choice(["upsert", "delete"])) for k in range(9)] for n in range(3)]
    index = bucket_index.BucketIndex(spark, str(tmp_path / "index"), "key", ["at"], 4)
    for n, rows in enumerate(batches):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key int, at int, value string, op string").parquet(str(tmp_path / "in"))
        bucket_index.drain(stream, index, str(tmp_path / "check")).awaitTermination()
        assert sorted(str(tuple(r)) for r in index.read().select("key", "at", "value").collect()) == plain(batches[: n + 1])
        assert len(index.versions()) == n + 1


# archives

EDGE = "id string, source string, target string, type string, strength double, evidence array<string>"


def test_archives_merge_and_stay(spark):
    one = spark.createDataFrame([("1", "a", "b", "is", 0.5, ["c1"]), ("2", "b", "a", "is", 0.7, ["c2"]), ("3", "b", "a", "has", 0.6, ["c3", "c1"]), ("4", "b", "a", "is", 0.2, ["c4"])], EDGE)
    columns = [*one.columns, "archive"]
    first = graph.collapse_relations(one).select(*columns)
    entries = {(x.type, x.direction): (x.evidence, x.edges) for x in first.first().archive}
    assert entries == {("is", "reversed"): (["c1"], 1), ("has", "as_is"): (["c1", "c3"], 1)}
    assert found(graph.collapse_relations(first).select(*columns)) == found(first)
    more = spark.createDataFrame([("5", "a", "b", "is", 0.9, ["c9"]), ("6", "a", "b", "is", 0.9, ["c1"]), ("7", "x", "y", "is", 0.1, None)], EDGE).withColumn("archive", F.array().cast(first.schema["archive"].dataType))
    second = graph.collapse_relations(first.unionByName(more))
    kept = {r["lo"]: r for r in second.collect()}
    assert {(x.type, x.direction): (x.evidence, x.edges) for x in kept["a"].archive} == {("is", "reversed"): (["c1", "c2", "c4"], 2), ("has", "as_is"): (["c1", "c3"], 1)}
    assert kept["x"].archive == [] and found(graph.collapse_relations(second.select(*columns)).select(*columns)) == found(second.select(*columns))


# chapters

def plain_chapters(tree, numbers):
    """The starts of confirmed chapters, or nothing."""
    runs, last = [], None
    for page in sorted(p for p, v in numbers.items() if v is not None):
        if last is not None and page == last + 1 and numbers[page] == numbers[last] + 1:
            runs[-1].append(page)
        else:
            runs.append([page])
        last = page
    tree = sorted(tree)
    if len(tree) < 2:
        return []
    right = 0
    for run in (r for r in runs if len(r) >= 3):
        at = [k for k, (s, _) in enumerate(tree) if s <= run[0]]
        if not at:
            if run[-1] >= tree[0][0]:
                return []
            continue
        start, value = tree[at[-1]]
        if at[-1] + 1 < len(tree) and run[-1] >= tree[at[-1] + 1][0] or numbers[run[0]] != value + run[0] - start:
            return []
        right += 1
    return [(s, k + 1) for k, (s, _) in enumerate(tree)] if right else []


def test_chapter_restarts(spark):
    rng = random.Random(11)
    sections, candidates, want = [], [], set()
    for doc in range(150):
        tree = sorted((s, rng.choice([1, 1, 3])) for s in rng.sample(range(2, 24), rng.randint(0, 3)))
        numbers = {}
        for page in range(26):
            own = [t for t in tree if t[0] <= page]
            true = page - own[-1][0] + own[-1][1] if own else page + 1
            numbers[page] = rng.choice([true] * 30 + [None]) if rng.random() > 0.002 else true + 1
        if doc % 5 == 0:
            numbers = {p: p + 1 for p in numbers}
        if doc % 7 == 0:
            numbers = dict.fromkeys(numbers)
        sections += [(doc, *t) for t in tree]
        candidates += [(doc, p, v) for p, v in numbers.items()]
        want |= {(doc, *c) for c in plain_chapters(tree, numbers)}
    out = trust.chapter_restarts(spark.createDataFrame(sections, "doc int, start int, value int"), spark.createDataFrame(candidates, "doc int, page int, value int"))
    assert {tuple(r) for r in out.collect()} == want and len({d for d, *_ in want}) > 20


def test_page_trust_gates_labels(spark):
    """Exactly half of the pages with publisher labels is too few; blind pages say so; fallback labels are no evidence."""
    pages = spark.createDataFrame([(d, p, p != 3) for d in range(3) for p in range(4)], "doc int, page int, has_text boolean")
    labels = spark.createDataFrame([(0, p, f"{p + 7}", 1) for p in range(4)] + [(1, p, f"{p + 7}", 1 if p < 2 else 2) for p in range(4)] + [(2, p, f"{p + 7}", 2) for p in range(4)], "doc int, page int, label string, tier int")
    none = spark.createDataFrame([], "doc int, page int, value int")
    out = {(r["doc"], r["page"]): (r["label"], r["source"]) for r in trust.build_page_trust(pages, labels, none, none.select("doc", F.col("page").alias("start"), "value")).collect()}
    assert [out[0, p] for p in range(4)] == [("7", "pdf_label_sane"), ("8", "pdf_label_sane"), ("9", "pdf_label_sane"), ("4", "blind")]
    assert {out[d, p] for d in (1, 2) for p in range(3)} == {("1", "physical_only"), ("2", "physical_only"), ("3", "physical_only")}


@pytest.mark.parametrize("count", [0, 1])
def test_no_books(spark, count):
    none = spark.createDataFrame([], "doc int, page int, value int")
    assert trust.chapter_restarts(none.select("doc", F.col("page").alias("start"), "value"), none).count() == 0
