"""What larger tables do: no session closes, many copies of a form, one frequent word, long documents."""

import datetime

import duckdb
from lectern import plans


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_events_too_dense_for_a_session_to_close(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=20 * i), "view") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = plans.QUERIES["debounced_runs"](spark, str(tmp_path))
    assert found.collect() == []
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute(plans.ORACLES["debounced_runs"])
    assert expected.fetchall() == [] and [c[0] for c in expected.description] == found.columns


def test_pointers_make_no_row_of_a_pair(spark):
    from lectern.operators import anchors

    said = [f"line {i} of a long document, told in full" for i in range(30)]
    entries = spark.createDataFrame([(1, i, str(i), t) for i, t in enumerate(said)] + [(2, 0, "x", "short")], "doc long, seq int, cfi string, text string")
    rows = [("a", 1, said[3] + " " + said[5]), ("b", 1, "nothing of it"), ("c", 2, "short"), ("d", 3, said[0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc long, text string")
    found = anchors.pointers(chunks, entries)
    assert _rows(found)[:3] == [("a", "3", "5"), ("b", "0", "0"), ("c", "x", "x")] and len(_rows(found)) == 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "Aggregate" not in joined  # pairs were grouped above the join


def test_run_together_pages_are_found_by_letters_of_any_plane(spark):
    from lectern.operators import quotes

    words = [f"𐐨word{i}x" for i in range(3000)]
    pages = spark.createDataFrame([(1, 0, "other words stand here"), (1, 1, "".join(words))], "doc long, page int, text string")
    quote = " ".join(words[2000:2010])
    asked = spark.createDataFrame([(7, 1, quote, None)], "quote_id long, doc long, quote string, hint int")
    row = quotes.locate_quotes(asked, pages).collect()[0]
    assert (row["page"], row["step"], row["place"]) == (1, len(quotes.LADDER), len("".join(words[:2002])))
    plan = quotes.locate_quotes(asked, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") >= 2  # pages give postings of asked windows only


def test_equal_requests_meet_equal_families_once(spark):
    from lectern.operators import graph

    families = [(f"{i}:{form}", form, "", [form], 1, 2 + i % 5) for i in range(300) for form in ("Ab", "Abbey")]
    roots = spark.createDataFrame(families, "root string, form string, type string, forms array<string>, members long, mentions long")
    queries = spark.createDataFrame([(i, " Ab") for i in range(1200)], "query_id long, q string")  # more than MOST_REQUESTS, all the same
    got = graph.search_entities(roots, queries, limit=2).collect()
    assert len(got) == 2400 and {(r.root, r.tier, r.rank) for r in got} == {("104:Ab", 1, 1), ("109:Ab", 1, 2)}


def test_expansion_makes_no_row_of_a_query_and_a_chunk(spark, monkeypatch):
    from lectern.operators import graph, recall

    named = [(f"e{(i * j) % 23}", f"{i % 40}:{i}") for i in range(1, 400) for j in range(1, 2 + i % 6)]
    mentions = spark.createDataFrame(named, "entity_id string, chunk_id string")
    seeds = spark.createDataFrame([(q, f"{i % 40}:{i}") for q in range(30) for i in (q + 1, q + 100)][:-1] + [(99, "none")], "query_id long, chunk_id string")
    stable = mentions.select("entity_id").filter("entity_id <> 'e0'")
    links = {}
    held = set(named)
    for q, seed in [(r.query_id, r.chunk_id) for r in seeds.collect()]:
        links.setdefault(q, set()).update(e for e, c in held if c == seed and e != "e0")
    own = {(r.query_id, r.chunk_id) for r in seeds.collect()}
    expected = []
    for q, wanted in links.items():
        counts = {}
        for e, c in held:
            if e in wanted and (q, c) not in own:
                counts[c] = counts.get(c, 0) + 1
        expected += [(q, c, r + 1, n) for r, (c, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10])]
    found = graph.expand(seeds, mentions, stable).select("query_id", "id", "rank", "links")
    assert _rows(found) == sorted(expected)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # every pair was a row
    monkeypatch.setattr(recall, "CELLS", 3)
    assert _rows(graph.expand(seeds, mentions, stable).select("query_id", "id", "rank", "links")) == sorted(expected)
    monkeypatch.setattr(recall, "MOST_BYTES", 0)
    assert _rows(graph.expand(seeds, mentions, stable).select("query_id", "id", "rank", "links")) == sorted(expected)


def _task(monkeypatch, df, make):
    """What ``make(df)`` would run over a task's Arrow batches."""
    held = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append(f) or self)
        make(df)
    return held[0]


def test_tasks_work_on_bounded_parts_of_a_batch(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from lectern.operators import chunk, recall

    docs = spark.createDataFrame([], "id long, text string, bag array<string>, vector array<double>")
    out = list(_task(monkeypatch, docs, lambda d: chunk.chunk_table(d, "id", "text"))(iter([pa.RecordBatch.from_pydict({"id": range(2000), "text": ["word " * 400] * 2000})])))
    assert sum(len(b) for b in out) == 2000 and max(b.nbytes for b in out) < 3 << 20

    seen, counted, add = [], recall._counted, recall.Best.add
    monkeypatch.setattr(recall, "_counted", lambda bag, known: seen.append(len(bag.flatten())) or counted(bag, known))
    asked = recall.Asked([1, 2], ["a", "b"], [[0], [0, 1]], [[0], [0, 1]])
    queries = spark.createDataFrame([], "query_id long")
    f = _task(monkeypatch, docs, lambda d: recall.lexical(asked, queries, d.select("id", "bag"), 3, 1.2, 0.75, 1.0, ("sparse",)))
    bags = [["a"] * (i % 7) + ["b"] * (i % 5) + ["x"] * 200 for i in range(4000)]
    got = [tuple(r.values()) for b in f(iter([pa.RecordBatch.from_pydict({"id": range(4000), "bag": bags})])) for r in b.to_pylist()]
    assert max(seen) <= 1 << 18 and len(seen) > 1
    assert [r[:3] for r in got if r[1] == 1] == [(0, 1, i) for i in (6, 13, 20)] and [r[2] for r in got if r[1] == 2] == [34, 69, 104]

    added = []
    monkeypatch.setattr(recall.Best, "add", lambda self, query, ids, score: added.append(len(query)) or add(self, query, ids, score))
    rng = np.random.default_rng(1)
    rows, wanted = rng.normal(size=(4000, 8)), rng.normal(size=(1000, 8))
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wanted)], "query_id long, vector array<double>")
    f = _task(monkeypatch, docs, lambda d: recall.nearest(held, d, 3))
    got = {}
    for b in f(iter([pa.RecordBatch.from_pydict({"id": range(4000), "vector": rows.tolist()})])):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append(r["id"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(wanted) @ unit(rows).T, 6)
    assert max(added) <= 1 << 18 and [got[q] for q in range(1000)] == [np.lexsort((np.arange(4000), -s))[:3].tolist() for s in scores]


def test_anchor_positions_look_at_sentences_that_are_judged_once(spark):
    from lectern.operators import anchors

    said = [f"The winter{p} market{p} of town{p} number{p} opens its gates quietly." for p in range(6)]
    pages = spark.createDataFrame([(1, p, t, True) for p, t in enumerate(said)], "doc int, page int, text string, prose boolean")
    sentences = spark.createDataFrame([(1, p, 0, t, p != 0) for p, t in enumerate(said)], "doc int, page int, seq int, text string, in_column boolean")
    out = anchors.sample_anchors(sentences, pages, 20)
    best = {(r.position, r.page, r.relaxed) for r in out.filter("rank = 1").collect()}
    assert best == {("front", 1, False), ("middle", 2, False), ("back", 4, False)}
    assert "xxhash64" not in out._jdf.queryExecution().optimizedPlan().toString()  # every position hashed all windows again


def test_a_refresh_shuffles_a_stored_row_once(spark, tmp_path, monkeypatch):
    from lectern.operators import graph
    from lectern.streaming import bucket_index
    from pyspark.sql import functions as F

    index = bucket_index.BucketIndex(spark, f"file://{tmp_path}/index", "k", [], 2)
    index.apply(spark.range(60).select(F.struct("id").alias("k"), F.lit("a").alias("v"), F.lit("upsert").alias("op")), 0)
    written = []
    kind = type(spark.range(1))
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda df: written.append(df) or write(df)))
    ops = spark.range(50, 70).select(F.struct("id").alias("k"), F.lit("b").alias("v"), F.when(F.col("id") % 2 == 0, "upsert").otherwise("delete").alias("op"))
    index.apply(ops.unionByName(ops.withColumn("op", F.lit("delete"))), 1)  # of a key's operations the greatest counts
    assert {(r.k.id, r.v) for r in index.read().collect()} == {(i, "a") for i in range(50)} | {(i, "b") for i in range(50, 70, 2)}
    data = next(df for df in written if "held" in df._jdf.queryExecution().optimizedPlan().toString())
    plan = data._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # a bucket's rows met the batch, then moved again, to as many tasks as buckets

    entities = spark.createDataFrame([(f"{d}:{f}", f, d, "X", None, 1) for d in (1, 2) for f in ("Aa", "Bb")], "id string, form string, doc_id long, type string, alias_of string, chunks long")
    relations = spark.createDataFrame([(f"{d}:Aa", f"{d}:Bb", "t", 0.5, [f"{d}:0"], d) for d in (1, 2)], "source string, target string, type string, strength double, evidence array<string>, doc_id long")
    chunks = spark.createDataFrame([("1:0", 1, True), ("2:0", 2, False)], "chunk_id string, doc_id long, body boolean")
    bound = graph.bind_aliases(entities, None, F.col("form"))  # counted already: mentions are not read
    near = [graph.read_model(*[df.drop("doc_id") for df in (bound, relations)], chunks), graph.read_model(bound, relations, chunks)]
    assert near[0].collect() == near[1].collect() and [(r.docs, r.quality, r.rows) for r in near[1].collect()] == [(2, 0.5, 2)]


def test_batch_starts_need_no_struct_a_page(spark):
    from lectern.operators import trust
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(b, p) for b in (0, 7, 30, 1000) for p in (0, 1, 2, 9, 50)] + [(5, None)], "bytes long, pages int")
    both = rows.select(trust.scan_batches(F.col("bytes"), F.col("pages"), 10).alias("b"), trust.batch_starts(F.col("bytes"), F.col("pages"), 10).alias("s"))
    assert all(r.s == [x.start for x in r.b] and all(x.end - x.start >= 1 for x in r.b) for r in both.collect())
    assert "lambda" not in both.select("s")._jdf.queryExecution().optimizedPlan().toString()  # structs were made and taken apart


def test_gate_by_document_equals_gate_by_chunk(spark):
    from lectern.operators import graph

    entities = spark.createDataFrame([(f"{d}:{f}", f, d) for d in (1, 2, 3) for f in ("A", "B", "C", "D")], "id string, form string, doc_id long")
    mentions = spark.createDataFrame([("1:A", "1:0", 1), ("1:A", "1:1", 1), ("1:B", "1:0", 1), ("2:A", "2:0", 2), ("2:B", "2:1", 2), ("2:C", "2:1", 2), ("3:A", "3:1", 3)], "entity_id string, chunk_id string, doc_id long")
    edges = [("x", "1:A", "1:C", ["1:1", "1:0", "1:1", None], 1), ("y", "1:A", "1:B", ["1:1"], 1), ("z", "2:B", "2:C", ["2:0"], 2), ("u", "2:B", "2:C", ["2:1", "2:0"], 2), ("v", "3:A", "3:D", [], 3), ("w", "3:A", "3:D", ["3:1"], 3)]
    relations = spark.createDataFrame(edges, "id string, source string, target string, evidence array<string>, doc_id long")
    gated = spark.createDataFrame([("1:0", 1), ("2:0", 2), ("9:0", 9)], "chunk_id string, doc_id long")
    tables = (entities, mentions, relations)
    by_chunk = graph.gate(*[t.drop("doc_id") for t in tables], gated.drop("doc_id"))
    by_document = graph.gate(*tables, gated)
    for a, b in zip(by_chunk, by_document, strict=True):
        assert _rows(a) == _rows(b.drop("doc_id"))
    assert [(r.id, r.evidence) for r in by_document[2].orderBy("id").collect()] == [("u", ["2:1"]), ("w", ["3:1"]), ("x", ["1:1", "1:1"])]
    assert "posexplode" not in by_document[2]._jdf.queryExecution().optimizedPlan().toString()  # evidence was a row a chunk, twice shuffled


def test_a_document_s_relations_meet_its_aliases_once(spark):
    from lectern.operators import graph

    relations = spark.createDataFrame([("a", "1:A", "1:B", 1), ("b", "1:B", "1:C", 1), ("c", "2:A", "2:C", 2)], "id string, source string, target string, doc_id long")
    pairs = spark.createDataFrame([("1:A", "9:A", 1), ("1:B", "9:A", 1), ("2:C", "9:C", 2), ("2:A", "2:A", 2)], "id string, survivor string, doc_id long")
    by_id, by_document = graph.repoint(relations, pairs.drop("doc_id")), graph.repoint(relations, pairs)
    assert _rows(by_id) == _rows(by_document) == [("b", "9:A", "1:C", 1), ("c", "2:A", "9:C", 2)]
    assert by_document._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # each end was a join

    both = graph.neighbors(spark.createDataFrame([("r", "s", "t")], "source string, target string, type string"), spark.createDataFrame([("r", 2), ("s", 3)], "root string, mentions long"), spark.createDataFrame([("r",), ("s",)], "id string"))
    assert _rows(both) == [("r", "s", "t", True, 1), ("s", "r", "t", False, 1)]
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()  # the model was computed for each direction


def test_collapsed_pairs_carry_earlier_archives_without_a_join(spark):
    from lectern.operators import graph

    schema = "id string, source string, target string, type string, strength double, evidence array<string>, archive array<struct<type:string,direction:string,evidence:array<string>,edges:bigint>>"
    old = [("t", "as_is", ["c9"], 2), ("u", "reversed", ["c8"], 1)]
    edges = spark.createDataFrame([("1", "a", "b", "t", 0.5, ["c1", "c2"], old), ("2", "b", "a", "t", 0.9, ["c3"], None), ("3", "a", "b", "u", 0.1, [], [("t", "as_is", ["c9", "c7"], 1)]), ("4", "a", "b", "t", 0.2, ["c1"], [])], schema)
    out = graph.collapse_relations(edges)
    row = out.collect()
    assert len(row) == 1 and (row[0].id, row[0].source, row[0].type, row[0].strength, row[0].evidence, row[0].edges) == ("1", "a", "t", 0.5, ["c1", "c2"], 4)
    assert [tuple(x) for x in row[0].archive] == [("t", "as_is", ["c7", "c9"], 3), ("t", "reversed", ["c3"], 1), ("u", "as_is", [], 1), ("u", "reversed", ["c8"], 1)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # the collapse ran once for its rows and again for its archives


def test_pages_meet_their_quotes_once(spark, monkeypatch):
    import re

    from lectern.operators import quotes

    plain = [f"Größe{i} – des ﬁnsteren Waldes{i % 7}, Zeile\t{i}!" for i in range(60)]
    books = {1: plain, 2: [" ".join(plain[i : i + 20]).replace(" ", "\x02") for i in range(0, 60, 10)], 3: ["...", "", "one two"], 4: plain[:9] + [" ".join(plain[9:])]}
    said = [(10 * d + k, d, " ".join(plain[at : at + 3]).upper().replace("SS", "ss"), at if k % 2 else None) for d in (1, 2, 3, 4, 5) for k, at in enumerate((3, 17, 41, 55))]
    said += [(90, 4, "zeile 5", None), (91, 4, None, None), (92, None, said[0][2], None)]
    pages = spark.createDataFrame([(d, p, t) for d, texts in books.items() for p, t in enumerate(texts)] + [(2, 99, None), (None, 0, plain[3])], "doc long, page int, text string")
    asked = spark.createDataFrame(said, "quote_id long, doc long, quote string, hint int")
    found = quotes.locate_quotes(asked, pages)
    got = _rows(found.select("quote_id", "page", "step", "proven", "core", "core_all", "hits", "place").fillna(-1))
    assert [r[0] for r in got] == sorted(q[0] for q in said) and {r[0] for r in got if r[1] >= 0} == {10 * d + k for d in (1, 2, 4) for k in range(4)}
    spelled = lambda t: "".join(c for c in t.replace("ß", "ss").replace("ﬁ", "fi") if c.isalnum()).lower()
    for q, page, step, *_, place in [r for r in got if r[1] >= 0]:
        text = books[q // 10][page]
        words = [w for w in map(spelled, next(x[2] for x in said if x[0] == q).split()) if w]
        low, high, _ = quotes.LADDER[step % len(quotes.LADDER)]
        before = spelled(text).index("".join(words[slice(low, high)]))
        assert place == max(i for i in range(len(text) + 1) if len(spelled(text[:i])) <= before)
    assert {r[2] >= len(quotes.LADDER) for r in got if r[1] >= 0} == {True, False}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LogicalRDD \[[^\]]*page#", plan)) == 1  # texts were read, moved and made into words again and again
    monkeypatch.setattr(quotes, "FEW_WINDOWS", 0)
    assert _rows(quotes.locate_quotes(asked, pages).fillna(-1)) == got
