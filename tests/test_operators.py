"""Literal cases of single operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.functions import frontmatter as fm
from lectern.functions import text as t
from lectern.operators import anchors, chunk, extract, graph, jobs, locate, persist, repair, seams, search, sync, trust
from lectern.plans import graph_queries, text_queries
from lectern.sources import files, library
from lectern.streaming import outbox


def values(spark, column, items):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_term_forms(spark):
    given = ["Stakeholder-Theory", "Doppelte Wesentlichkeiten", "Straße", "ESG", "Ökonomie", "100%_wildcard", "Haus", "höhen", None]
    assert values(spark, t.norm_term, given) == ["stakeholdertheori", "doppeltewesentlichkeit", "strass", "esg", "ökonomi", "100wildcard", "haus", "höh", None]
    assert values(spark, t.alias_stem, ["Nachhaltigkeitsberichte", "nachhaltigkeits  Berichts", "Haus", "Autos"]) == ["nachhaltigkeitsbericht", "nachhaltigkeits bericht", "haus", "autos"]


def test_small_parsers(spark):
    assert values(spark, t.year_of, ["2021-05-01", "03/1999", "n.d.", "12.07.2003", "0999"]) == [2021, 1999, None, 2003, None]
    assert values(spark, lambda c: t.clamp_param(c, 10, 1, 50), ["7", "99", "-3", "x", None]) == [7, 50, 1, 10, 10]
    assert values(spark, t.decode_file_url, ["file:///a%20b+c.pdf"]) == ["/a b+c.pdf"]
    assert values(spark, t.short_cfi, ["epubcfi(/6/4!/4/2,/1:0,/1:5)", "epubcfi(/6/8)"]) == ["/6/4!/4/2", "/6/8"]
    assert values(spark, t.image_refs, [r"![a](x/y\_z.png) ![b](https://h/i.png)"]) == [["x/y_z.png"]]
    assert values(spark, t.image_basenames, ["![a](/tmp/run/x.png) t"]) == ["![a](x.png) t"]
    assert values(spark, lambda c: t.truncate_bytes(c, 5), ["höhen", "abc", "日本語"]) == ["höhe", "abc", "日"]
    assert values(spark, lambda c: t.roman_value(t.roman(c.cast("int"))), ["1", "49", "1994", "3999"]) == [1, 49, 1994, 3999]
    assert values(spark, t.roman_value, ["iiii", "XIV", ""]) == [None, 14, None]
    assert values(spark, t.vector_of, ["[0.5,2]"]) == [[0.5, 2.0]]
    assert values(spark, t.sparse_map, ['{"a": "0.5", "b": 2}']) == [{"a": 0.5, "b": 2.0}]
    assert values(spark, t.heading_text, ['## <span id="p"></span>**Über _uns_** ']) == ["Über uns"]
    with pytest.raises(Exception, match="positive finite"):
        values(spark, t.sparse_map, ['{"a": "-1"}'])
    assert values(spark, t.hashed_sparse, ["b a b"])[0].values() and len(values(spark, t.hashed_vector, ["x"])[0]) == 3


def test_names_and_files(spark):
    creators = "array<struct<creatorType:string,firstName:string,lastName:string,name:string>>"
    df = spark.createDataFrame([([("editor", "a", "E", ""), ("author", "b", "Lee", "")], 2020, "A/B  title", "P"), ([], 0, "word " * 30, "Bank"), (None, None, "t", None)], f"c {creators}, y int, t string, p string")
    got = [r[0] for r in df.select(t.schema_filename(F.col("c"), F.col("y"), F.col("t"), F.col("p"))).collect()]
    assert got[0] == "Lee - 2020 - A B title.pdf" and got[1].startswith("Bank - - word") and got[1].endswith("word….pdf") and got[2] == "Unbekannt - - t.pdf"
    assert values(spark, extract.keep_entity, ["Lee et al.", "firms", "x", "Acme Corp"]) == [False, False, False, True]
    assert values(spark, extract.entity_type, ["book or journal", "colour"]) == ["WORK", None]


def test_front_matter(spark):
    kinds = {
        "### **Inhaltsverzeichnis**\nx": "toc", "# Literaturverzeichnis-\n- a": "bibliography", "## _Vorwort_": "preface", "> Vorwort": "preface",
        "Marco Englert Anabel Ternès *Hrsg.*": "authors", "## Titel\n**24**\nA. Autor": "title_lines", "## Titel\n**24**\n" + "Satz " * 40: "",
        "| 1 a | 3 |\n| 2 b | 5 |\n| 3 c | 9 |": "toc", "| a | 1999 |\n| b | 2001 |\n| c | 2003 |": "", "1.1 Begriffe\n2. Formeln 3 und 4 im Text.": "",
        "Kapital 41 Markt 52 Umsatz 63\nErtrag 7, 9 Gewinn 11 Kosten 12": "index", "Kapital 41. Markt 52 Umsatz 63": "", "": "",
    }
    assert values(spark, fm.front_matter_class, list(kinds)) == list(kinds.values())
    assert values(spark, fm.front_matter_class, [None]) == [""]


def test_fusion_cap_and_fold(spark):
    a = spark.createDataFrame([(1, "x", 1, 9.0), (1, "y", 2, 8.0)], "query_id int, id string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 9.0), (1, "z", 2, 8.0)], a.schema)
    assert [r.id for r in search.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.id for r in search.rrf([a.filter("id='x'"), b.filter("id='z'").withColumn("rank", F.lit(1))]).orderBy("rank").collect()] == ["x", "z"]
    hits = spark.createDataFrame([(1, f"b{i}", i, 0.0) for i in range(1, 7)], a.schema)
    owner = spark.createDataFrame([(f"b{i}", "A" if i < 5 else "B") for i in range(1, 7)], "id string, owner string")
    assert [r.id for r in search.cap_with_refill(hits, owner, 2).orderBy("rank").collect()] == ["b1", "b2", "b5", "b6", "b3", "b4"]
    docs = spark.createDataFrame([("b1", "A", "one two three four five six"), ("b2", "A", "one two three four five six"), ("b3", "B", "one two three four five six"), ("b4", "A", "else")], "id string, owner string, text string")
    folded = search.fold_near_duplicates(hits, docs).orderBy("rank").collect()
    assert [(r.id, r.folded) for r in folded] == [("b1", 1), ("b3", 0), ("b4", 0)]
    bare = spark.createDataFrame([("b1", "A", "!!! ???"), ("b2", "A", "!!! ???"), ("b3", "B", "!!! ???"), ("b4", "A", "..."), ("b5", "A", None)], docs.schema)
    folded = search.fold_near_duplicates(hits, bare).orderBy("rank").collect()
    assert [(r.id, r.folded) for r in folded] == [("b1", 1), ("b3", 0), ("b4", 0), ("b5", 0)]
    scores = spark.createDataFrame([(1, "x", 0.1), (1, "y", 0.9)], "query_id int, id string, rerank double")
    assert [r.id for r in search.rerank(a, scores).orderBy("rank").collect()] == ["y", "x"]
    assert [r.id for r in search.rerank(a, scores.filter("id = 'y'")).orderBy("rank").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        search.fetch_count(65)


def test_knn_drops_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, vector array<float>")
    found = search.knn(rows.filter("id = 1").withColumnRenamed("id", "query_id"), rows, 5, block=2)
    assert [(r.id, r.score) for r in found.orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107)]


def ent(spark, rows):
    return spark.createDataFrame(rows, "id string, form string, type string, alias_of string")


def test_alias_guards_and_idempotence(spark):
    e = ent(spark, [("1", "Nachhaltigkeitsbericht", "CONCEPT", None), ("2", "Nachhaltigkeitsberichte", "", None), ("3", "Nachhaltigkeitsberichts", "WORK", None), ("4", "Schmidt", "PERSON", None), ("5", "Schmidt", "PERSON", None), ("6", "Eva Maria Schulz", "PERSON", None), ("7", "Eva Maria Schulz", "PERSON", None)])
    m = spark.createDataFrame([("2", "c1"), ("2", "c2"), ("1", "c1")], "entity_id string, chunk_id string")
    bound = graph.bind_aliases(e, m, t.alias_stem(F.col("form")))
    assert {r.id: r.alias_of for r in bound.collect()} == {"1": "2", "2": None, "3": "2", "4": None, "5": None, "6": None, "7": "6"}
    again = graph.bind_aliases(bound, m, t.alias_stem(F.col("form")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, bound.collect()))


def test_relations_and_browse(spark):
    e = ent(spark, [("a", "Aa", "ORG", None), ("b", "Bb", "", None)])
    m = spark.createDataFrame([(x, f"d{i}:0") for x in "ab" for i in range(3)], "entity_id string, chunk_id string")
    r = spark.createDataFrame([("1", "a", "b", "is", 0.5, ["d0:0"]), ("2", "b", "a", "is", 0.7, ["d1:0"]), ("3", "b", "a", "is", 0.6, ["d2:0", "d1:0"]), ("4", "a", "a", "is", 0.1, ["d0:0"])], "id string, source string, target string, type string, strength double, evidence array<string>")
    one = graph.collapse_relations(r.filter("source <> target")).first()
    assert (one.source, one.target, one.id, one.edges, one.evidence, one.strength) == ("b", "a", "2", 3, ["d1:0", "d2:0"], 0.7)
    assert [(x.type, x.direction, x.edges) for x in one.archive] == [("is", "reversed", 1)]
    chunks = spark.createDataFrame([(f"d{i}:0", i, True) for i in range(3)], "chunk_id string, doc_id int, body boolean")
    model = graph.read_model(e, r, chunks)
    row = model.first()
    assert (row.source, row.target, row.docs, row.rows) == ("b", "a", 3, 3) and abs(row.confidence - 0.75) < 1e-9
    ends = graph.gate(e, m, r, spark.createDataFrame([("d0:0",)], "chunk_id string"))
    assert [x.count() for x in ends] == [2, 4, 2]
    engine = Engine({"chunks": chunks.select("chunk_id", F.col("doc_id").alias("document_id"), F.lit("x").alias("attachment_id"), F.col("doc_id").alias("chunk_index"), F.lit("t").alias("text"), F.lit(1).alias("snapshot_id"), F.lit(True).alias("active")), "entities": e, "mentions": m, "relations": r})
    assert engine.kg_relations().count() == 1 and engine.kg_neighbors(e.select("id")).count() == 2
    assert engine.passage(spark.createDataFrame([("d1:0",), ("zz",)], "chunk_id string")).orderBy("chunk_id").select("state").collect()[1][0] == "unknown"
    two = spark.createDataFrame([(f"{g}{i}", 1, "x", i, f"{g}{i}", g, g == "n") for g in "on" for i in range(3)], "chunk_id string, document_id int, attachment_id string, chunk_index int, text string, snapshot_id string, active boolean")
    sides = Engine({"chunks": two}).passage(spark.createDataFrame([("n1",), ("o1",)], "chunk_id string")).orderBy("chunk_id")
    assert [(r.state, r.before, r.after) for r in sides.collect()] == [("active", "n0", "n2"), ("superseded", None, None)]
    assert {k: v.count() for k, v in engine.consolidate().items()}["entities"] == 2 and engine.bound_entities().count() == 2


def test_triple_parser(spark):
    got = values(spark, extract.parse_triples, ["<s><triplet> Marie Curie <per> Warsaw <loc> place of birth<triplet> Curie <per> radium <misc> discovered</s>", "none"])
    assert [(x.head, x.tail_type, x.relation) for x in got[0]] == [("Marie Curie", "loc", "place of birth"), ("Curie", "misc", "discovered")] and got[1] == []


def test_chunkers():
    text = "# One\n\nalpha beta\n\n### Deep\n\n" + "word " * 30 + "\n\n{4}----\n\n" + "tail " * 20 + "\n\n# Two\n\nend"
    plain = chunk.plain_chunks(text, 45)
    assert [p.headings for p in plain] == [["One"], ["One", "Deep"], ["One", "Deep"], ["Two"]]
    assert plain[2].pages == [(0, "5")] and plain[0].text == "# One\n\nalpha beta"
    budget = chunk.budget_chunks(text, 60, 5, 3)
    assert [p.headings for p in budget] == [["One"], ["One", "Deep"], ["One", "Deep"], ["Two"]]
    assert budget[2].text.startswith("word word word word word\n\ntail") and budget[2].pages == [(0, "1"), (26, "5")]
    assert chunk.budget_chunks(None) == [] and chunk.budget_chunks("\n\n \n\n") == []
    long = chunk.split_large("a b c. " * 100, 50, 0)
    assert all(chunk.tokens_of(x) <= 50 for x in long) and "".join("".join(long).split()).count("c") == 100
    assert len(chunk.budget_chunks("one two\n\n" * 400, 100, 0, 50)) > 1


def test_page_trust(spark):
    c = spark.createDataFrame([("d", p, v) for p, v in [(0, 1), (1, 2), (2, 3), (3, 9), (4, 1), (5, 2), (6, 3), (7, 4), (9, 5)]], "doc string, page int, value int")
    assert trust.folio_runs(c).groupBy("run").count().count() == 2
    assert sorted((r.page, r.value) for r in trust.verified_folios(c).collect()) == [(4, 1), (5, 2), (6, 3), (7, 4)]
    chapters = spark.createDataFrame([("d", 0, 1), ("d", 4, 2)], "doc string, start int, ordinal int")
    assert trust.verified_folios(c, chapters).count() == 7
    lines = spark.createDataFrame([("d", p, "top", 0, x) for p, x in enumerate(["12", "Journal 22 Vol. 3", "iv", "1999", "A heading 15", "L 333/80", "see the text.", "16/144", "Issue 3.4 of 7"])], "doc string, page int, zone string, seq int, line string")
    found = [(r.page, r.form, r.value) for r in trust.harvest_lines(lines).orderBy("page", "seq").collect()]
    assert found == [(0, "bare", "12"), (1, "mid", "22"), (1, "trail", "3"), (2, "roman", "iv"), (3, "weak", "1999"), (4, "trail", "15"), (5, "lseries", "80"), (7, "eli", "16"), (8, "trail", "7")]
    harvest = spark.createDataFrame([("d", 0, "bare", "7", "top", 0), ("d", 1, "lead", "3", "top", 0), ("d", 1, "trail", "8", "top", 1), ("d", 2, "weak", "1999", "bot", 0)], "doc string, page int, form string, value string, zone string, seq int")
    assert [(r.page, r.value) for r in trust.pick_candidates(harvest).orderBy("page").collect()] == [(0, "7"), (1, "8"), (2, "1999")]
    pages = spark.createDataFrame([("d", 4)], "doc string, page_count int")
    heavy = harvest.union(spark.createDataFrame([("d", 3, "lead", "3", "top", 0)], harvest.schema))
    assert trust.drop_constants(heavy, pages).filter("value = '3'").count() == 0


def test_sync(spark):
    items = spark.createDataFrame([("p", None, False), ("c", "p", False), ("o", None, False)], "key string, parent_key string, deleted boolean")
    gone = sync.apply_deletes(items, spark.createDataFrame([("p",)], "key string"))
    assert {r.key: r.deleted for r in gone.collect()} == {"p": True, "c": True, "o": False}
    stored = spark.createDataFrame([("k", 5, "old")], "key string, v int, t string")
    older, same = (spark.createDataFrame([("k", v, "new")], stored.schema) for v in (4, 5))
    assert sync.upsert(stored, older, ["key"], "v", "t").first().t == "old" and sync.upsert(stored, same, ["key"], "v", "t").first().t == "new"
    files_ = spark.createDataFrame([("d", "b", "application/epub+zip", False), ("d", "z", "application/pdf", False), ("d", "a", "application/pdf", True)], "document_id string, key string, content_type string, deleted boolean")
    assert sync.preferred_attachment(files_).first().key == "z"
    snaps = spark.createDataFrame([(1, "a", True, 1), (2, "a", True, 2), (3, "b", False, 1), (4, "c", True, 1)], "id int, attachment_id string, active boolean, created_at int")
    att = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "attachment_id string, deleted boolean")
    assert {r.id: r.active for r in sync.retire_and_revive(snaps, att).collect()} == {1: False, 2: True, 3: True, 4: False}
    found = spark.createDataFrame([("x", "STATS_MISMATCH"), ("x", "REF_DUPLICATE")], "owner string, code string")
    assert sync.first_violation(found, "owner").first().code == "REF_DUPLICATE"
    changed = sync.changed_only(stored.withColumn("t", F.lit(None).cast("string")), stored, "key", ["t"])
    assert changed.count() == 1


def test_jobs(spark):
    log = spark.createDataFrame([("j", i, e) for i, e in enumerate(["claim", "fail", "claim", "renew", "fail", "claim", "fail", "claim", "enqueue"])], "job string, n int, e string")
    assert tuple(jobs.fold(log, "job", ["n"], "e").first()) == ("j", "pending", 0, 1)
    row = spark.range(1).select(jobs.verdict_status(F.lit("auto_apply"), F.lit(0.95), F.lit(0)), jobs.verdict_status(F.lit("auto_apply"), F.lit(0.95), F.lit(1)), jobs.repair_claim(F.lit("queued"), F.lit(2)), outbox.decide(F.lit("upsert"), F.lit(False)), outbox.retry_state(F.lit(9), F.lit(True))).first()
    assert tuple(row)[:4] == ("in_repair", "blocked", "blocked", "skip") and row[4].state == "dead"


def test_passages(spark):
    df = spark.createDataFrame([(5, '[[0,"1"],["4","2"],[9,"3"],["x","y"]]'), (99, "[]")], "at int, p string")
    assert [r[0] for r in df.select(locate.page_at(F.col("at"), locate.paragraph_pages(F.col("p")), F.lit("first"))).collect()] == ["2", "first"]


def epub(blob: io.BytesIO) -> bytes:
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><h1>Alpha</h1><div><p>One  two</p></div></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p>First</p></body></html>")
    return blob.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub(io.BytesIO()))
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    read = files.read_files(spark, str(tmp_path), "*.epub")
    rows = files.epub_blocks(read).orderBy("chapter", "seq").collect()
    assert [(r.chapter, r.cfi, r.tag, r.text) for r in rows] == [(0, "epubcfi(/6/2!/2/2)", "p", "First"), (1, "epubcfi(/6/4!/2/2)", "h1", "Alpha"), (1, "epubcfi(/6/4!/2/4/2)", "p", "One two")]
    assert files.epub_markdown((tmp_path / "x.epub").read_bytes()) == "First\n\n# Alpha\n\nOne two"
    marked = values(spark, files.page_markers, ['a <span id="x_page_7"></span>[7] b'])[0]
    assert "{6}" + "-" * 48 in marked and "[7]" not in marked


def test_library(spark, tmp_path):
    (tmp_path / "i.json").write_text("\n".join([
        '{"key":"A","version":3,"data":{"itemType":"statute","nameOfAct":"Act","dateEnacted":"2001-02-03","creators":[{"firstName":"E","lastName":"F"},{"name":"Org"},{"firstName":" "}]}}',
        '{"key":"B","version":9,"parentItem":"A","data":{"itemType":"attachment","contentType":"application/pdf","deleted":1}}']))
    items = library.read_items(spark, str(tmp_path))
    doc = library.normalize(items).collect()
    assert [(d.key, d.title, d.year, d.authors) for d in doc] == [("A", "Act", 2001, ["E F", "Org"])]
    assert library.next_cursor(items, 4).first()[0] == 9 and library.increment(items, 4).count() == 1 and library.attachments(items).first().deleted
    assert [r[0] for r in library.deleted_events(items, spark.createDataFrame([("Z",)], "key string")).orderBy("key").collect()] == ["B", "Z"]


def test_snapshot_store(spark, tmp_path):
    store = persist.SnapshotStore(spark, f"file://{tmp_path}/s")
    df = spark.range(5)
    store.persist("g1", {"t": df}, {"t": 5})
    with pytest.raises(ValueError):
        store.persist("g2", {"t": spark.range(4)}, {"t": 5})
    assert store.active() == "g1" and store.table("t").count() == 5
    store.persist("g3", {"t": spark.range(7)}, {"t": 7})
    assert store.active() == "g3" and store.table("t").count() == 7


def test_partition_count_changes_nothing(spark, data):
    from lectern.plans import QUERIES

    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), "text")
    asked = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    one = search.hybrid(asked.coalesce(1), docs.coalesce(1)).collect()
    many = search.hybrid(asked.repartition(5), docs.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and QUERIES["hybrid_search"](spark, data).count() == len(one)


def test_label_repair(spark):
    a = spark.createDataFrame([("o", 3, "1", "4"), ("o", 9, "7", "10"), ("p", 2, "3", "9"), ("p", 5, "6", "12"), ("t", 1, "5", "6"), ("t", 9, "13", "16"), ("i", 4, "", "1"), ("i", 8, "", "5"), ("u", 1, "1", "2")], "doc string, page int, label string, truth string")
    assert {r["doc"]: r["class"] for r in repair.offset_classes(a).collect()} == {"o": "constant-offset", "p": "reprint-start", "t": "two-range", "i": "injection", "u": "unclassifiable"}
    spec = [(0, "", "D", 1)]
    books = spark.createDataFrame(
        [("o", "constant-offset", spec, [(3, 1, 4), (9, 7, 10)], []), ("t", "two-range", spec, [(1, 2, 3), (9, 10, 13)], [(4, 6), (5, 9)]), ("r", "two-range", spec, [(1, 2, 3), (9, 10, 13)], []), ("i", "injection", [], [(4, None, 3)], [(3, 2), (2, 1)])],
        f"doc string, class string, spec array<{repair.RANGE}>, anchors array<struct<page:int,n:int,m:int>>, folio array<struct<page:int,value:int>>")
    made = {r.doc: r for r in repair.plans(books).collect()}
    assert [tuple(x) for x in made["o"].spec] == [(0, "", "D", 4)] and made["r"].spec is None and "0 places" in made["r"].refused
    assert [tuple(x) for x in made["t"].spec] == [(0, "", "D", 2), (5, "", "D", 9)]
    assert [tuple(x) for x in made["i"].spec] == [(0, "", "r", 1), (2, "", "D", 1)]


def test_anchors(spark):
    assert anchors.find_tolerant("a  long – winded\ntext", "long - winded text") == 3 and anchors.find_tolerant(None, "x") == -1
    assert anchors.strip_running_head("INTRODUCTION 12 | The sentence itself is long enough to stay whole here.", "12") == "The sentence itself is long enough to stay whole here."
    pages = spark.createDataFrame([("d", p, f"This is sentence number {p} of the text. It costs approx. ten units and goes on like that.") for p in range(6)], "doc string, page int, text string")
    rows = anchors.sentence_rows(pages)
    assert rows.count() == 12
    picked = anchors.anchor_candidates(rows, 1)
    assert {r.part for r in picked.collect()} == {"front", "middle", "back"}
    names = spark.createDataFrame([("d", 0, "Acme"), ("d", 1, "ACME Corp"), ("d", 2, "UN"), ("d", 3, "un")], "doc string, seq int, name string")
    known = spark.createDataFrame([("d", 0, "Acme Corporation")], "doc string, seq int, text string")
    assert [r.entity for r in anchors.resolve_names(names, known).orderBy("seq").collect()] == ["Acme Corporation", "Acme Corporation", "UN", "UN"]
    geometry = spark.range(1).select(anchors.is_prose_page(F.array(F.lit(300.0), F.lit(10.0), F.lit(320.0)), F.lit(500.0)), anchors.in_one_column(F.array(F.lit(10.0), F.lit(12.0), F.lit(400.0))))
    assert tuple(geometry.first()) == (True, True)


def test_seams(spark):
    texts = spark.createDataFrame([(i, "bad" if i == 20 else f"t{i}") for i in range(40)], "id int, text string")

    def load():
        def model(batch):
            if "bad" in batch:
                raise RuntimeError
            return [([1.0, 2.0], {"a": 1.0}) for _ in batch]

        return model

    got = seams.embed(texts.coalesce(1), "id", "text", load, 2).collect()
    assert len(got) == 40 and sum(r.embedding == [0.0, 0.0] for r in got) == 16
    pairs = spark.createDataFrame([(1, i, "q", "x" * i) for i in range(3)], "query_id int, id int, query string, text string")
    assert [r.rerank for r in seams.rerank_scores(pairs, lambda: lambda q, t: [float(len(x)) for x in t]).orderBy("id").collect()] == [0.0, 1.0, 2.0]
    found = spark.createDataFrame([("c", "Acme", "ORG", 3, 0.5), ("c", "Acme", "ORG", 9, 0.9), ("c", "firms", "ORG", 1, 0.9), ("c", "Lee et al.", "PERSON", 1, 0.9)], "chunk_id string, text string, type string, start int, confidence double")
    assert [(r.text, r.confidence, r.mentions) for r in seams.named_entities(found).collect()] == [("Acme", 0.9, [3, 9])]
    modes = spark.createDataFrame([("c", "included"), ("e", "excluded")], "collection_key string, mode string")
    members = spark.createDataFrame([("c", "2"), ("c", "1"), ("c", "1")], "collection_key string, document_id string")
    assert [(r.document_ids, r.documents) for r in sync.resolved_view(members, modes).orderBy("collection_key").collect()] == [(["1", "2"], 2), ([], 0)]


def test_expansion_follows_frequent_entities(spark, tmp_path):
    docs = [(100, "Alpha rare"), (7, "\n".join(["Alpha"] * 60)), (8, "Other")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = graph_queries.graph_expand(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.links) for r in got] == [(100, i, 1) for i in sorted(f"7:{i}" for i in range(60))[:10]]


def test_hybrid_uses_every_arm_and_folds(spark):
    copy = "apple one two three four five six seven eight"
    docs = spark.createDataFrame([("a1", "A", copy), ("a2", "A", copy), ("a3", "A", "apple pear nine"), ("b", "B", "dense only"), ("c", "C", "linked only")], "id string, owner string, text string")
    q = spark.createDataFrame([(1, "apple one")], "query_id int, text string")
    found = lambda **arms: [r.id for r in search.hybrid(q, docs, **arms).orderBy("rank").collect()]
    assert found() == ["a1", "a3"] and found(fold=False) == ["a1", "a2", "a3"]
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("gone", [1.0, 0.0])], "id string, vector array<double>")
    assert set(found(query_vectors=asked, row_vectors=vectors)) == {"a1", "a3", "b"}
    mentions = spark.createDataFrame([("e", "a1"), ("e", "c")], "entity_id string, chunk_id string")
    linked = lambda seeds: graph.expand(seeds, mentions, mentions.select("entity_id").distinct())
    assert set(found(graph_arm=linked)) == {"a1", "a3", "c"}
    assert found(rerank_scores=lambda hits: hits.select("query_id", "id", F.when(F.col("id") == "a3", 1.0).otherwise(0.5).alias("rerank")))[0] == "a3"
    chunks = docs.select(F.col("id").alias("chunk_id"), F.col("owner").alias("document_id"), "text", F.lit(True).alias("active"))
    engine = Engine({"chunks": chunks, "mentions": mentions, "vectors": vectors.withColumnRenamed("id", "chunk_id")})
    assert {r.id for r in engine.search(q, query_vectors=asked, graph_arm=True).collect()} == {"a1", "a3", "b", "c"}
    with pytest.raises(ValueError, match="vectors"):
        search.hybrid(q, docs, query_vectors=asked)


def test_front_matter_queries_read_the_texts(spark, tmp_path):
    toc, cited = "\n".join(f"{i}.2 Markt ..... {20 + i}" for i in range(1, 6)), "\n".join(f"- Lee, A. ({1990 + i}): Title, In: Verlag X, S. {i + 3}" for i in range(6))
    texts = [(0, "Plain prose."), (1, cited), (4, "# Vorwort-\nx"), (5, "Plain prose."), (6, toc), (13, "Kapital 41, Markt 51 Umsatz, 161\nErtrag 7, 9 Gewinn 11 Kosten 12")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r["class"], r.front_matter) for r in text_queries.frontmatter_class_texts(spark, str(tmp_path)).collect()}
    assert got == {0: ("", False), 1: ("bibliography", True), 4: ("preface", True), 5: ("", False), 6: ("toc", True), 13: ("index", False)}
    counts = {r["class"]: (r.documents, r.gated) for r in text_queries.gate_counts_texts(spark, str(tmp_path)).collect()}
    assert counts == {"": (2, 0), "bibliography": (1, 1), "preface": (1, 1), "toc": (1, 1), "index": (1, 1), "total": (6, 4)}
