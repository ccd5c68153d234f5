"""Entities and relations from text by rule: the deterministic stand-ins for the models, and parsers of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import WORD_CHARS

ENTITY = "^[A-Z][A-Za-z0-9_]{2,}$"


def entity_mentions(chunks: DataFrame) -> DataFrame:
    """One row a capitalised word of three and more characters: the input's columns, pos, form. Each mention is its own form's."""
    each = chunks.select("*", F.posexplode(F.split("text", f"[^{WORD_CHARS}]+")).alias("pos", "form")).drop("text")
    return each.filter(F.col("form").rlike(ENTITY))


def forms(c: Column) -> Column:
    """The forms of ``entity_mentions`` in one text, in order: found where words begin, without a string for every word."""
    return F.regexp_extract_all(c, F.lit(f"[A-Z](?<![{WORD_CHARS}][A-Z])[A-Za-z0-9_]{{2,}}+(?![{WORD_CHARS}])"), F.lit(0))


def neighbouring(forms_: Column) -> Column:
    """Structs (head, tail) of the forms that follow each other in a text; equal ones are among them."""
    n = F.greatest(F.size(forms_) - 1, F.lit(0))
    return F.arrays_zip(F.slice(forms_, F.lit(1), n).alias("head"), F.slice(forms_, F.lit(2), n).alias("tail"))


def adjacent_pairs(mentions: DataFrame, within: str = "chunk_id") -> DataFrame:
    """(within, head, tail) of neighbouring, different forms in a chunk."""
    before = F.lag("form").over(W.partitionBy(within).orderBy("pos"))
    return mentions.withColumn("head", before).filter("head <> form").select(within, "head", F.col("form").alias("tail"))


def parse_triples(c: Column) -> Column:
    """Structs head, head_type, tail, tail_type, relation from ``<triplet> head <type> tail <type> relation``."""
    pattern = "<triplet>\\s*([^<]+?)\\s*<([^>]+)>\\s*([^<]+?)\\s*<([^>]+)>\\s*([^<]+?)\\s*(?=<triplet>|</s>|$)"
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in range(1, 6)]
    names = ("head", "head_type", "tail", "tail_type", "relation")
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names, strict=True)]), lambda x: F.struct(*[x[n].alias(n) for n in names]))


def relation_type(c: Column) -> Column:
    """Lower case, blanks as underscores, at most 64 characters."""
    return F.substring(F.regexp_replace(F.lower(F.trim(c)), "[\\x09-\\x0D\\x20]+", "_"), 1, 64)


def assemble(found: DataFrame) -> DataFrame:
    """Merge (source, target, relation, chunk_id, strength) into edges with their evidence."""
    return found.groupBy("source", "target", relation_type(F.col("relation")).alias("type")).agg(F.max("strength").alias("strength"), F.sort_array(F.collect_set("chunk_id")).alias("evidence"))


#: Words that name no one, and what a model's labels are called here.
GENERIC = "firm firms workers government governments countries borrowers savers lenders households".split()
TYPES = {"person": "PERSON", "organization": "ORGANIZATION", "location": "LOCATION", "concept": "CONCEPT", "book or journal": "WORK", "research method": "METHOD"}


def keep_entity(form: Column) -> Column:
    """The filter after a model: 2 to 100 characters, no ``et al.`` at the end, no generic word alone."""
    text = F.trim(form)
    return F.length(text).between(2, 100) & ~text.rlike("(?i)\\bet\\s+al\\.?$") & ~F.lower(text).isin(*GENERIC)


def entity_type(label: Column) -> Column:
    """The type of a model's label; null for labels that aren't used."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), label)


def sentences(c: Column, least: int = 25, most: int = 600) -> Column:
    """Spans that end in . ! ? … and have a fitting length."""
    spans = F.filter(F.split(c, "(?<=[.!?…])(?![.!?…])"), lambda x: x.rlike("[.!?…]$"))
    return F.filter(F.transform(spans, lambda x: F.trim(x)), lambda x: F.length(x).between(least, most))
