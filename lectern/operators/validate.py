"""All checks of a processor's result in one pass: the first failure, in the order in which checks run.

A result is one nested row. Arrays are judged item by item where the order of items decides which failure comes first; references
across arrays are resolved by set operations within the row, and repeated references are looked for only if there are fewer distinct
ones, so a result of many chunks takes time in proportion. No row meets another. Null arrays are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trust levels of page references, relationships that need no evidence, the type of sources without pages.
PAGE_SOURCES = ("folio_verified", "pdf_label_sane", "physical_only", "blind")
SEQUENTIAL = ("sequential_next", "sequential_prev")
EPUB = "application/epub+zip"
RELATION = "array<struct<type:string,evidence:array<string>>>"
SCHEMA = (
    "struct<source:struct<attachment_id:string,content_hash:string,verified:boolean>,"
    "chunks:array<struct<index:int,text:string,ref:string,image_refs:array<string>,dense:struct<dimensions:int,values:array<double>>,sparse:map<string,string>,"
    "locator:struct<type:string,page_source:string,cfi_start:string,cfi_end:string>>>,"
    f"entities:array<struct<ref:string,mentions:array<string>>>,artifacts:array<struct<ref:string>>,entity_relationships:{RELATION},chunk_relationships:{RELATION},"
    "stats:struct<chunks:int,entities:int,artifacts:int,entity_relationships:int,chunk_relationships:int>>"
)


def _first(items: Column, judge: Callable[..., Column]) -> Column:
    """The first code that ``judge`` gives to an item."""
    return F.get(F.filter(F.transform(items, judge), lambda c: c.isNotNull()), F.lit(0))


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _code(bad: Column, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), code)


def _refs(items: Column, kind: str) -> Column:
    """Empty and repeated references of one array, whichever item comes first."""
    refs = F.transform(items, lambda x: F.coalesce(x["ref"], F.lit("")))
    suspect = (F.size(F.array_distinct(refs)) < F.size(refs)) | F.array_contains(refs, "")
    return F.when(suspect, _first(refs, lambda r, i: F.when(r == "", f"{kind}_REF_EMPTY").when(F.array_position(refs, r) <= i, f"{kind}_REF_DUPLICATE")))


def _chunk_indexes(chunks: Column) -> Column:
    judge = lambda c, i: F.coalesce(F.when(~c["index"].eqNullSafe(i), "CHUNK_INDEX_NONCONTIGUOUS"), _code(_empty(F.trim(F.regexp_replace(c["text"], "[\\x09-\\x0D]", " "))), "CHUNK_EMPTY"))
    return _first(chunks, judge)


def _dense(chunks: Column, dimensions: int) -> Column:
    def judge(c: Column) -> Column:
        d, values = c["dense"], c["dense"]["values"]
        declared = _code(d["dimensions"] != dimensions, "DENSE_DIM_MISMATCH") if dimensions > 0 else F.lit(None).cast("string")
        other = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return F.when(d.isNotNull(), F.coalesce(declared, _code(F.coalesce(F.size(values), F.lit(0)) != d["dimensions"], "DENSE_DIM_VALUES"), _code(other, "DENSE_NON_FINITE")))

    return _first(chunks, judge)


def _sparse(chunks: Column) -> Column:
    def judge(c: Column) -> Column:
        keys, values = F.map_keys(c["sparse"]), F.map_values(c["sparse"])
        return F.coalesce(_code(F.array_contains(keys, ""), "SPARSE_KEY_EMPTY"), _code(F.exists(values, lambda v: v.try_cast("double").isNull()), "SPARSE_VALUE_INVALID"))

    return _first(chunks, judge)


def _locators(chunks: Column, epub: Column) -> Column:
    def judge(c: Column) -> Column:
        at, source = c["locator"], F.coalesce(c["locator"]["page_source"], F.lit(""))
        pages = F.when(epub, "LOCATOR_FABRICATED_PAGES").when(source == "", "LOCATOR_PAGE_SOURCE_MISSING").when(~source.isin(*PAGE_SOURCES), "LOCATOR_PAGE_SOURCE_UNKNOWN")
        cfi = F.when(epub & (_empty(at["cfi_start"]) | _empty(at["cfi_end"])), "LOCATOR_CFI_EMPTY").when(~source.isin("", "none"), "LOCATOR_PAGE_SOURCE_INCONSISTENT")
        return F.when(at.isNull(), "LOCATOR_MISSING").when(at["type"] == "page_span", pages).when(at["type"] == "epub_cfi", cfi).otherwise("LOCATOR_TYPE_UNKNOWN")

    return _first(chunks, judge)


def _evidence(relations: Column, known: Column | None) -> Column:
    def judge(r: Column) -> Column:
        missing = F.when(F.coalesce(F.size(r["evidence"]), F.lit(0)) == 0, "RELATIONSHIP_NO_EVIDENCE")
        lost = F.when(F.size(F.array_except(r["evidence"], known)) > 0, "RELATIONSHIP_EVIDENCE_UNRESOLVED") if known is not None else F.lit(None).cast("string")
        return F.when(~F.coalesce(r["type"].isin(*SEQUENTIAL), F.lit(False)), F.coalesce(missing, lost))

    return _first(relations, judge)


def first_failure(result: Column, frozen: Column, dimensions: int = 0) -> Column:
    """The code of the first check that fails, null if none does. ``result`` is of SCHEMA; ``frozen`` is a struct (attachment_id,
    content_hash, content_type) of what was claimed; ``dimensions`` is the declared size of dense vectors, not checked if 0."""
    source = result["source"]
    held = lambda name: F.coalesce(result[name], F.array())
    chunks, entities, artifacts = held("chunks"), held("entities"), held("artifacts")
    refs = F.transform(chunks, lambda c: c["ref"])
    images = F.flatten(F.transform(chunks, lambda c: F.coalesce(c["image_refs"], F.array().cast("array<string>"))))
    mentions = F.flatten(F.transform(entities, lambda e: F.coalesce(e["mentions"], F.array().cast("array<string>"))))
    bare = lambda c: F.regexp_replace(c, "^sha256:", "")
    counts = ("chunks", "entities", "artifacts", "entity_relationships", "chunk_relationships")
    stats = [F.size(held(name)) != F.coalesce(result["stats"][name], F.lit(0)) for name in counts]
    return F.when(result.isNull() | frozen.isNull(), "RESULT_INVALID").otherwise(F.coalesce(
        F.when(~source["attachment_id"].eqNullSafe(frozen["attachment_id"]), "SOURCE_IDENTITY_MISMATCH"),
        F.when(frozen["content_hash"].isNotNull() & ~bare(source["content_hash"]).eqNullSafe(bare(frozen["content_hash"])), "SOURCE_HASH_MISMATCH"),
        F.when(~F.coalesce(source["verified"], F.lit(False)), "SOURCE_NOT_VERIFIED"),
        _chunk_indexes(chunks), _refs(chunks, "CHUNK"), _refs(entities, "ENTITY"), _refs(artifacts, "ARTIFACT"),
        F.when(F.size(F.array_except(images, F.transform(artifacts, lambda a: a["ref"]))) > 0, "CHUNK_IMAGE_REF_UNRESOLVED"),
        F.when(F.size(F.array_except(mentions, refs)) > 0, "ENTITY_MENTION_CHUNK_UNRESOLVED"),
        _dense(chunks, dimensions), _sparse(chunks), _locators(chunks, F.coalesce(frozen["content_type"] == EPUB, F.lit(False))),
        _evidence(held("entity_relationships"), refs), _evidence(held("chunk_relationships"), None),
        *[F.when(wrong, "STATS_MISMATCH") for wrong in stats],
    ))
