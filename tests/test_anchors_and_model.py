"""Anchor sampling against the rules read one by one; the stored graph model against rebuilds; runs that wait for quiet."""

import datetime
import random
import re

from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.operators import anchors, graph, jobs
from lectern.operators.model_store import ModelStore
from lectern.streaming import debounce


def plain_anchors(pages, sentences, least_chars, least_pages=4):
    """{position: [(page, seq, relaxed)]} of one document."""
    texts = {p: " ".join(t.split()) for p, t, _ in pages}
    body = sorted(p for p, t, prose in pages if prose and len(texts[p]) >= least_chars)
    if len(body) < least_pages:
        return {}
    thirds = body[: len(body) // 3], body[len(body) // 3 : 2 * len(body) // 3], body[2 * len(body) // 3 :]

    def words_on(p, four):
        w = texts[p].split()
        return any(w[i : i + 4] == four for i in range(len(w) - 3))

    def allowed(p, text, relaxed, column):
        w = text.split()
        text = " ".join(w)
        if not 6 <= len(w) <= 45 or re.search(anchors.BOILERPLATE, text) or re.search(anchors.ABBREVIATION_END, text) or texts[p].count(text) != 1:
            return False
        if any(sum(words_on(q, w[k : k + 4]) for q in texts) != 1 for k in (1, 2)):
            return False
        return relaxed or len(w) >= 8 and bool(re.match(anchors.SENTENCE_START, text)) and not re.search("[0-9]{3,}", text) and max(map(len, w)) >= 8 and column

    out, used = {}, set()
    for name, own in zip(anchors.POSITIONS, thirds, strict=True):
        scan = [p for p in own if p not in used] + [p for p in body if p not in own and p not in used]
        listed = []
        for p in scan:
            here = [s for s in sentences if s[0] == p and allowed(p, s[2], False, s[3])]
            listed += [(s[0], s[1], False) for s in sorted(here, key=lambda s: (-len(s[2].split()), s[1]))]
        if not listed:
            every = [s for p in scan for s in sentences if s[0] == p and allowed(p, s[2], True, s[3])]
            listed = [(s[0], s[1], True) for s in sorted(every, key=lambda s: -len(s[2].split()))]
        if listed:
            out[name] = listed
            used.add(listed[0][0])
    return out


def test_anchor_sampling(spark):
    rng = random.Random(13)
    vocabulary = ["Buchstabe", "und", "die", "Der", "Seite", "1234", "copyright", "längere", "kurz", "wort", "Nr"] + [f"w{i}" for i in range(60)]
    page_rows, sentence_rows, want = [], [], {}
    for doc in range(40):
        pages, sentences = [], []
        head = "Dies ist eine laufende Kopfzeile mit vielen gleichen Worten."
        for page in range(rng.randint(2, 9)):
            made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14))) + "." for _ in range(rng.randint(0, 5))] + ([head] if doc % 3 == 0 else [])
            pages.append((page, "  ".join(made), rng.random() < 0.8))
            sentences += [(page, k, s, doc % 4 != 1 and rng.random() < 0.9) for k, s in enumerate(made)]
        page_rows += [(doc, *p) for p in pages]
        sentence_rows += [(doc, *s) for s in sentences]
        for position, listed in plain_anchors(pages, sentences, 60).items():
            want[doc, position] = listed
    out = anchors.sample_anchors(spark.createDataFrame(sentence_rows, "doc int, page int, seq int, text string, in_column boolean"), spark.createDataFrame(page_rows, "doc int, page int, text string, prose boolean"), 60)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["doc"], r["position"]), []).append((r["page"], r["seq"], r["relaxed"]))
    assert got == want and any(x[0][2] for x in want.values()) and any(not x[0][2] for x in want.values())


# stored model

def world(spark, rng, alias):
    entities = [(str(i), f"F{i}", rng.choice(["ORG", "PERSON", ""]), str(alias[i]) if i in alias else None) for i in range(40)]
    mentions = [(str(i), f"c{rng.randrange(60)}") for i in range(40) for _ in range(3)]
    relations = [(f"r{k}", str(rng.randrange(40)), str(rng.randrange(40)), rng.choice(["is", "has"]), 0.5, [f"c{rng.randrange(60)}"]) for k in range(80)]
    return entities, mentions, relations


def frames(spark, e, m, r):
    return (
        spark.createDataFrame(e, "id string, form string, type string, alias_of string"), spark.createDataFrame(m, "entity_id string, chunk_id string").distinct(),
        spark.createDataFrame(r, "id string, source string, target string, type string, strength double, evidence array<string>"),
    )


def test_refreshed_model_equals_rebuild(spark, tmp_path):
    rng = random.Random(17)
    chunks = spark.createDataFrame([(f"c{i}", i % 9, i % 4 != 0) for i in range(60)], "chunk_id string, doc_id int, body boolean")
    e, m, r = world(spark, rng, {5: 1, 6: 1, 9: 2})
    store = ModelStore(spark, str(tmp_path / "model"), 16)
    assert store.version() is None and store.read("roots") is None

    def same():
        tables = frames(spark, e, m, r)
        triples, roots = graph.read_model(tables[0], tables[2], chunks), graph.roots(tables[0], tables[1])
        for part, whole in (("triples", triples), ("roots", roots)):
            assert sorted(map(str, store.read(part).select(*whole.columns).collect())) == sorted(map(str, whole.collect())), part

    store.refresh(*frames(spark, e, m, r), chunks)
    same()
    steps = [
        {"5", "7", "1"},  # a binding moves, another is new
        {"30", "31"},  # a mention and a relation come
        {"9"},  # an entity goes, with what it has
    ]
    e = [(i, f, t, {"5": "3", "7": "1"}.get(i, a)) for i, f, t, a in e]
    store.refresh(*frames(spark, e, m, r), chunks, spark.createDataFrame([(x,) for x in steps[0]], "id string"))
    same()
    m, r = [*m, ("30", "c1")], [*r, ("new", "31", "30", "is", 0.9, ["c1", "c2"])]
    store.refresh(*frames(spark, e, m, r), chunks, spark.createDataFrame([(x,) for x in steps[1]], "id string"))
    same()
    e, m, r = [x for x in e if x[0] != "9"], [x for x in m if x[0] != "9"], [x for x in r if "9" not in x[1:3]]
    assert store.refresh(*frames(spark, e, m, r), chunks, spark.createDataFrame([(x,) for x in steps[2]], "id string")) == 3
    same()
    touched = sum(v == 3 for v in store.parts["triples"].manifest().values())
    assert 0 < touched < 16
    engine = Engine({"chunks": chunks}, store)  # browse needs no other table
    assert engine.kg_relations(limit=5).count() == 5 and engine.kg_neighbors(spark.createDataFrame([("3",)], "id string"), min_mentions=1).count() > 0


# runs that wait for quiet

def at(minute):
    return datetime.datetime(2024, 1, 1, 8) + datetime.timedelta(minutes=minute)


def test_two_bursts_give_two_runs_and_a_restart_none_twice(spark, tmp_path):
    calls = []
    held = debounce.Debounced(spark, str(tmp_path / "ledger"), lambda closed: calls.append(closed.count()))

    def put(*minutes):
        spark.createDataFrame([("lib", at(m)) for m in minutes], "library string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("library string, at timestamp").parquet(str(tmp_path / "in"))
        held.start(stream, "at", "library", "5 minutes", "1 minute", str(tmp_path / "check")).awaitTermination()

    put(0, 1, 2)
    run()
    assert calls == [] and held.runs() is None  # not quiet yet
    put(20, 21)
    run()
    assert calls == [1]
    put(60)
    run()
    assert calls == [1, 1]
    run()
    assert calls == [1, 1]
    ledger = held.runs().orderBy("first").collect()
    assert [(r["first"], r["until"], r["events"]) for r in ledger] == [(at(0), at(7), 3), (at(20), at(26), 2)] and len({r["batch"] for r in ledger}) == 2
    held.apply(held.runs().drop("batch"), ledger[0]["batch"])  # the same batch again
    assert calls == [1, 1]


def test_job_lists_and_marks(spark):
    rows = spark.createDataFrame([(i, i % 3, i // 2, "completed" if i % 2 else "failed", 5 if i > 2 else None) for i in range(8)], "job_id int, attachment_id int, enqueued_at int, status string, ack_pending_at int")
    assert [r["job_id"] for r in jobs.list_jobs(rows, 3).collect()] == [7, 6, 5] and jobs.list_jobs(rows, -1).count() == 8
    assert [r["job_id"] for r in jobs.list_jobs(rows, 1, 0).collect()] == [6, 3, 0]
    cleared = jobs.clear_acks(rows, spark.createDataFrame([(3,), (3,), (4,), (99,)], "job_id int"))
    assert {r["job_id"] for r in cleared.filter("ack_pending_at IS NOT NULL").collect()} == {4, 5, 6, 7} and cleared.count() == 8
    assert rows.filter(F.col("ack_pending_at").isNotNull()).count() == 5
