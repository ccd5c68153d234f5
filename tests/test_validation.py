"""Each code of the result checks once, and the order in which several failures are told."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluate, validate

GOOD = {
    "source": {"attachment_id": "own", "content_hash": "sha256:aa", "verified": True},
    "chunks": [{"index": i, "text": f"text {i}", "ref": f"c{i}", "image_refs": ["a0"], "dense": {"dimensions": 2, "values": [0.5, 1.0]}, "sparse": {"a": "0.5"}, "locator": {"type": "page_span", "page_source": "blind", "cfi_start": "", "cfi_end": ""}} for i in range(3)],
    "entities": [{"ref": "e0", "mentions": ["c0", "c2"]}, {"ref": "e1", "mentions": []}],
    "artifacts": [{"ref": "a0"}, {"ref": "a1"}],
    "entity_relationships": [{"type": "sequential_next", "evidence": []}, {"type": "part_of", "evidence": ["c1"]}],
    "chunk_relationships": [{"type": "cites", "evidence": ["c9"]}],
    "stats": {"chunks": 3, "entities": 2, "artifacts": 2, "entity_relationships": 2, "chunk_relationships": 1},
}
EPUB_LOCATOR = {"type": "epub_cfi", "page_source": "none", "cfi_start": "/2", "cfi_end": "/4"}


def put(*path, value):
    def change(r):
        at = r
        for step in path[:-1]:
            at = at[step]
        at[path[-1]] = value

    return change


CASES = {
    "": [],
    "SOURCE_IDENTITY_MISMATCH": [put("source", "attachment_id", value="x"), put("source", "verified", value=False)],
    "SOURCE_HASH_MISMATCH": [put("source", "content_hash", value="ab")],
    "SOURCE_NOT_VERIFIED": [put("source", "verified", value=None), put("chunks", 0, "ref", value="")],
    "CHUNK_INDEX_NONCONTIGUOUS": [put("chunks", 1, "index", value=2), put("chunks", 1, "text", value=" ")],
    "CHUNK_EMPTY": [put("chunks", 1, "text", value=" \t\n"), put("chunks", 2, "index", value=9)],
    "CHUNK_REF_EMPTY": [put("chunks", 1, "ref", value=None), put("chunks", 2, "ref", value="c0"), put("entities", 0, "mentions", value=[])],
    "CHUNK_REF_DUPLICATE": [put("chunks", 1, "ref", value="c0"), put("chunks", 2, "ref", value="")],
    "ENTITY_REF_EMPTY": [put("entities", 0, "ref", value="")],
    "ENTITY_REF_DUPLICATE": [put("entities", 1, "ref", value="e0"), put("artifacts", 1, "ref", value="")],
    "ARTIFACT_REF_EMPTY": [put("artifacts", 1, "ref", value="")],
    "ARTIFACT_REF_DUPLICATE": [put("artifacts", 1, "ref", value="a0")],
    "CHUNK_IMAGE_REF_UNRESOLVED": [put("chunks", 2, "image_refs", value=["a1", "a7"]), put("entities", 0, "mentions", value=["c7"])],
    "ENTITY_MENTION_CHUNK_UNRESOLVED": [put("entities", 1, "mentions", value=["c7"])],
    "DENSE_DIM_MISMATCH": [put("chunks", 0, "dense", value={"dimensions": 3, "values": [1.0]})],
    "DENSE_DIM_VALUES": [put("chunks", 0, "dense", "values", value=[1.0]), put("chunks", 1, "dense", "dimensions", value=3)],
    "DENSE_NON_FINITE": [put("chunks", 2, "dense", "values", value=[1.0, float("nan")]), put("chunks", 0, "sparse", value={"": "1"})],
    "SPARSE_KEY_EMPTY": [put("chunks", 1, "sparse", value={"": "1"})],
    "SPARSE_VALUE_INVALID": [put("chunks", 1, "sparse", value={"a": "one"})],
    "LOCATOR_MISSING": [put("chunks", 1, "locator", value=None), put("chunks", 2, "locator", "type", value="x")],
    "LOCATOR_PAGE_SOURCE_MISSING": [put("chunks", 1, "locator", "page_source", value=None)],
    "LOCATOR_PAGE_SOURCE_UNKNOWN": [put("chunks", 1, "locator", "page_source", value="guess")],
    "LOCATOR_TYPE_UNKNOWN": [put("chunks", 1, "locator", "type", value="line")],
    "LOCATOR_PAGE_SOURCE_INCONSISTENT": [put("chunks", 1, "locator", value=EPUB_LOCATOR | {"page_source": "blind"})],
    "RELATIONSHIP_NO_EVIDENCE": [put("entity_relationships", 1, "evidence", value=None)],
    "RELATIONSHIP_EVIDENCE_UNRESOLVED": [put("entity_relationships", 1, "evidence", value=["c1", "c8"]), put("chunk_relationships", 0, "evidence", value=[])],
    "STATS_MISMATCH": [put("stats", "chunk_relationships", value=0)],
}


def judged(spark, results, content_type="application/pdf"):
    rows = spark.createDataFrame([(k, None if r is None else json.dumps(r, allow_nan=True)) for k, r in enumerate(results)], "k int, body string")
    frozen = F.struct(F.lit("own").alias("attachment_id"), F.lit("aa").alias("content_hash"), F.lit(content_type).alias("content_type"))
    parsed = rows.select("k", F.from_json("body", validate.SCHEMA, {"allowNonNumericNumbers": "true"}).alias("r"))
    return [r["code"] for r in parsed.select("k", validate.first_failure(F.col("r"), frozen, 2).alias("code")).orderBy("k").collect()]


def test_every_code(spark):
    results = []
    for changes in CASES.values():
        r = copy.deepcopy(GOOD)
        for change in changes:
            change(r)
        results.append(r)
    assert judged(spark, [*results, None]) == [*[c or None for c in CASES], "RESULT_INVALID"]


@pytest.mark.parametrize("locator, code", [(EPUB_LOCATOR, None), (EPUB_LOCATOR | {"cfi_end": ""}, "LOCATOR_CFI_EMPTY"), (GOOD["chunks"][0]["locator"], "LOCATOR_FABRICATED_PAGES")])
def test_sources_without_pages(spark, locator, code):
    r = copy.deepcopy(GOOD)
    for c in r["chunks"]:
        c["locator"] = locator
    assert judged(spark, [r], validate.EPUB) == [code]


def test_report_files(spark, tmp_path):
    hits = spark.createDataFrame([("a", 1, 7, 1), ("a", 1, 8, 2), ("b", 1, 8, 1), ("b", 2, 9, 4)], "config string, query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 8), (2, 9)], "query_id int, id int")
    configs = spark.createDataFrame([("a",), ("b",)], "config string")
    records = evaluate.query_records(hits, gold, gold.select("query_id").unionByName(spark.createDataFrame([(3,)], "query_id int")), configs)
    evaluate.write_report(records, str(tmp_path / "report"))
    back = {(r["config"], r["query_id"]): r for r in spark.read.json(str(tmp_path / "report/records")).collect()}
    assert len(back) == 6 and back["a", 1]["top"] == [7, 8] and back["a", 1]["rr"] == 0.5 and back["a", 3]["top"] == []
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report/summary")).collect())
    assert "| a | 0.000 | 0.333 | 0.167 | 0.333 | 3 |" in text and "| b | 0.333 | 0.667 | 0.417 | 0.667 | 3 |" in text
