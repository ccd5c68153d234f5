"""Filter audit, winnowing and periodic runs: brute force, guarantees, and the awkward inputs of each."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import filter_audit, periodic, queries, winnow

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
CLASHES = ("id", "body", "part", "mask", "label", "bucket", "extra", "k", "h", "least", "digest", "start", "length", "period", "gram_hashes", "quality", "a.b")


def frame(spark, rows):
    """(doc_id, text, lang) with columns of awkward names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("own") for c in CLASHES})


def found(df):
    return [r.asDict() for r in df.collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


ODD = [(1, None, "en"), (2, "", None), (3, "", "en"), (None, "a b a b", "de"), (4, "a b a b", "de"), (5, "a b a b", ""), (5, "a b a b", "en"), (6, LONG, "en"), (7, LONG, "fr"), (8, "ÄÖ ABC # x y", "fr"), (8, "ÄÖ ABC # x y", "fr")]


# filter audit

def brute_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    judged = []
    for i, text, lang in docs:
        text = text or ""
        w = words_of(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs),
        }
        judged.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [j for j in left if j[1][x]]
                left = [j for j in left if not j[1][x]]
                total[x] += len(gone)
                failing = [j for j in own if j[1][x]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(j[1].values()) == 1 for j in failing), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(df, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in found(filter_audit.audit(df, labels))}


def test_filter_audit(spark, monkeypatch):
    random.seed(3)
    texts = [" ".join(random.choice(["a", "B", "the", "c|", "Long", f"w{i}"]) for _ in range(random.choice([0, 3, 99, 100, 130]))) for i in range(40)]
    docs = ODD + [(i, random.choice(texts), random.choice(["en", "de", None, "x"])) for i in range(100, 260)]
    labels = [(random.choice([None, *range(1, 260)]), random.choice([0, 1, None]), random.choice([0, 1, None])) for _ in range(150)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(frame(spark, docs), told) == brute_audit(docs, labels)
    assert audited(frame(spark, []), told) == {}
    assert audited(frame(spark, ODD), told.limit(0)) == brute_audit(ODD, [])
    monkeypatch.setattr(filter_audit, "HELD", 2)
    batches = frame(spark, docs).select(F.col("lang").alias("part"), F.lit(1).alias("mask"), F.lit(0).alias("label")).na.fill("", ["part"]).toArrow().to_batches()
    assert sum(np.sum(b["counts"].flatten().to_numpy()) for b in filter_audit.tally(iter(batches))) == 120 * len(docs)


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for mask, k in itertools.product(range(32), range(120)):
        steps = [s for s, x in enumerate(filter_audit.ORDERS[k]) if mask >> "ABCDE".index(x) & 1]
        assert table[mask, k] == min(steps, default=5)


# winnowing

def brute_winnow(text):
    """Positions by the definition; the hashes are the library's, tested to tell the grams apart."""
    hashes = winnow.grams(np.array(list(map(ord, text)), np.uint32)).tolist()
    size = min(winnow.K, len(text))
    grams = {text[i : i + size]: h for i, h in enumerate(hashes)}
    assert len(set(grams.values())) == len(grams) and all(grams[text[i : i + size]] == h for i, h in enumerate(hashes))
    width = min(winnow.WINDOW, len(hashes))
    at = []
    for s in range(len(hashes) - width + 1 if hashes else 0):
        window = hashes[s : s + width]
        pick = s + max(i for i, h in enumerate(window) if h == min(window))
        at += [pick] if not at or at[-1] != pick else []
    return [hashes[i] for i in at], at


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é日"])
@pytest.mark.parametrize("block", [winnow.BLOCK, 7])
def test_winnow(letters, block, monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK", block)
    rng = random.Random(len(letters))
    for n in [*range(0, 70), 200, 400, 1000]:
        text = "".join(rng.choice(letters) for _ in range(n))
        hashes, at = winnow.winnow(text)
        assert (hashes.tolist(), at.tolist()) == brute_winnow(text)
    assert winnow.winnow("a" * 500)[1].tolist() == list(range(47, 489))  # equal hashes: always the rightmost


def test_match_guarantee():
    """A shared passage of K + WINDOW - 1 code points gives a common hash at the same place of the passage."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(200):
        passage = make(winnow.K + winnow.WINDOW - 1)
        a, b = make(rng.randint(0, 99)), make(rng.randint(0, 99))
        one, two = winnow.winnow(a + passage + make(rng.randint(0, 50))), winnow.winnow(b + passage + make(rng.randint(0, 50)))
        first = {(h, p - len(a)) for h, p in zip(*map(np.ndarray.tolist, one), strict=True)}
        second = {(h, p - len(b)) for h, p in zip(*map(np.ndarray.tolist, two), strict=True)}
        assert any(0 <= p < winnow.WINDOW for _, p in first & second)


def by_order(docs):
    return sorted(docs, key=lambda d: -(1 << 63) if d[0] is None else d[0])


def brute_edited(docs):
    out = []
    for k, (i, text, *_) in enumerate(docs):
        text, following = text or "", docs[(k + 1) % len(docs)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        sets = [set(winnow.winnow(x)[0].tolist()) for x in (text, edited, following)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *(winnow.written(*winnow.winnow(x)) for x in (text, edited)), *like))
    return out


def edited_rows(df):
    return [tuple(r.values()) for r in found(winnow.edited(df))]


@pytest.mark.parametrize("buckets", [1, 16])
def test_edited(spark, buckets, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKETS_EACH", buckets)
    rng = random.Random(4)
    docs = [(i * 7 - 900, "".join(rng.choice("abcd é\n") for _ in range(rng.choice([0, 1, 3, 4, 50, 300]))) or None, "en") for i in range(300)]
    rng.shuffle(docs)
    assert sorted(edited_rows(frame(spark, docs))) == sorted(brute_edited(by_order(docs)))
    few = [(None, "no id " * 30, "en"), (5, LONG, "en"), (6, LONG, "en")]
    assert sorted(map(str, edited_rows(frame(spark, few)))) == sorted(map(str, brute_edited(few)))
    assert edited_rows(frame(spark, [])) == []
    one = edited_rows(frame(spark, [(3, "abcd" * 40, "en")]))
    assert one == brute_edited([(3, "abcd" * 40, "en")]) and one[0][6] == 1.0
    assert edited_rows(frame(spark, [(3, None, "en")]))[0][3:] == ("", "", 1.0, 1.0)


def test_edited_repeated_ids(spark, monkeypatch):
    """Rows of one id, a third of all, stay in one order and spread over buckets; each row is someone's successor once."""
    monkeypatch.setattr(winnow, "BUCKETS_EACH", 8)
    docs = [(77 if i % 3 == 0 else i, f"text number {i} " * (1 + i % 5), "en") for i in range(600)]
    df = frame(spark, docs)
    out = edited_rows(df)
    assert len(out) == len(docs)
    ordered = winnow.with_successor_order(df, "doc_id", "text").withColumn("p", F.spark_partition_id())
    assert ordered.filter("id = 77 AND NOT extra").groupBy("p").count().agg(F.max("count")).first()[0] < 120
    monkeypatch.setattr(winnow, "BUCKETS_EACH", 1)
    assert sorted(out) == sorted(edited_rows(df))


def test_annotate_and_postings(spark):
    df = frame(spark, ODD)
    out = found(winnow.annotate(df))
    assert len(out) == len(ODD) and set(df.columns) <= set(out[0]) and all(r["part"] == "own" for r in out)
    for r in out:
        assert (r["gram_hashes"], r["gram_positions"]) == tuple(x.tolist() for x in winnow.winnow(r["text"] or ""))
    assert winnow.postings(df).count() == sum(len(r["gram_hashes"]) for r in out)
    assert winnow.annotate(frame(spark, [])).count() == 0


# periodic runs

def brute_runs(ids):
    """Every maximal stretch of every period, less those that a shorter period explains."""
    out = []
    for q in range(1, len(ids) // 4 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(ids[x] == ids[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("sizes", [(1 << 8, 1 << 17, 1 << 14), (2, 8, 5)])
def test_runs(sizes, monkeypatch):
    for name, value in zip(("LONGEST", "SEGMENT", "PIECE"), sizes, strict=True):
        monkeypatch.setattr(periodic, name, value)
    rng = random.Random(1)
    for _ in range(600):
        n, letters, ids = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5]), []
        while len(ids) < n:
            ids += [rng.randrange(letters) for _ in range(rng.randint(1, 17))] * rng.choice([1, 1, 2, 4, 5, 6, 9])
            ids = ids[: len(ids) - rng.choice([0, 0, 0, 1, 3])]
        assert periodic.runs(np.array(ids[:n], np.int64)) == brute_runs(ids[:n])


def test_long_runs():
    assert periodic.runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    tiled = np.concatenate([[-1, -2], np.tile(np.arange(9_000), 4), [-1]])
    assert periodic.runs(tiled) == [(2, 36_000, 9_000)] and periodic.runs(tiled[:-2]) == []
    mixed = np.tile(np.array([0] * 300 + [1]), 40)
    assert periodic.runs(mixed) == sorted([(0, len(mixed), 301)] + [(301 * k, 300, 1) for k in range(40)], key=lambda r: (r[0], r[2]))


def brute_digest(i, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    dropped = {k for s, length, p in runs for k in range(s + p, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    numbers = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
    return (i, len(runs), *numbers, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_periodic_report(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "A", "é", "c d", "\n"]) for _ in range(rng.randint(0, 70))) for _ in range(400)]
    docs = [d for d in ODD if d[1] != LONG] + list(zip(range(1000, 1400), texts, itertools.repeat("en")))
    got = [tuple(r.values()) for r in found(periodic.report(frame(spark, docs)))]
    want = [brute_digest(i, x) for i, x, _ in docs]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[1] > 0 for r in want) > 20
    assert found(periodic.report(frame(spark, []))) == [] and found(periodic.spans(frame(spark, []))) == []
    spans, short = found(periodic.spans(frame(spark, docs))), {r["doc_id"]: r["collapsed_text"] for r in found(periodic.collapsed(frame(spark, docs)))}
    plain = {i: brute_runs(words_of(x)) for i, x, _ in docs}
    assert sorted((r["doc_id"], r["start"], r["length"], r["period"]) for r in spans if r["doc_id"] and r["doc_id"] >= 1000) == sorted((i, *r) for i, runs in plain.items() if i and i >= 1000 for r in runs)
    assert short[1] == "" and short[5] == "a b a b"


def test_periodic_long_text(spark):
    got = found(periodic.report(frame(spark, [(2, LONG, "en")])))[0]
    assert (got["n_runs"], got["start"]) == (0, None) and got["collapsed_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


@pytest.mark.parametrize("name, brute", [("op12_winnowing", None), ("op13_periodic_runs", brute_digest)])
def test_registered(spark, data, name, brute):
    """The registered queries on the whole smallest table."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r.values()) for r in found(queries.QUERIES[name](spark, data))]
    if brute is None:
        assert sorted(got) == sorted(brute_edited(by_order(docs)))
        same = sum(r[5] > r[6] for r in got if r[1] > 200)
        assert same > 0.9 * sum(r[1] > 200 for r in got)
    else:
        short = {i: x for i, x in docs if len(words_of(x)) < 900}
        assert len(got) == len(docs) and sorted(map(str, (r for r in got if r[0] in short))) == sorted(map(str, (brute(i, x) for i, x in short.items())))


# language ID

def test_remembered_words_and_many_labels(monkeypatch):
    """What a task remembers of words doesn't change results, and thousands of labels fit the work arrays."""
    from lectern.llm import langid

    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgh"))
    pieces = sorted({"".join(rng.choice(letters, rng.integers(1, 4))) for _ in range(300)} | {langid.MARK, langid.MARK + "a"})
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(rng.integers(0, 60))) or None for _ in range(90)]
    for labels in (3, 2000):
        model = langid.build(pieces, [f"l{i:04}" for i in range(labels)], rng.integers(0, 9, (len(pieces), labels)))
        wanted = [langid.Scorer(model).batch([t]) for t in texts]
        for most in (1, 100 * labels, 1 << 20):
            monkeypatch.setattr(langid, "REMEMBERED", most)
            scorer = langid.Scorer(model)
            names, scores = [], []
            for k in range(0, len(texts), 20):
                n, s = scorer.batch(texts[k : k + 20])
                names, scores = names + n, [*scores, *s]
                assert len(scorer.index) <= scorer.most
            assert names == [w[0][0] for w in wanted] and np.allclose(scores, [w[1][0] for w in wanted])


def test_release_removes_what_was_made(spark):
    from lectern.llm import common

    common.release(spark)
    path = common.fresh_dir(spark, "kept")
    spark.range(5).write.parquet(path)
    held = common.cut(spark.range(7))
    assert held.count() == 7 and common.release(spark) == 2 and common.release(spark) == 0
