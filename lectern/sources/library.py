"""Library sources: item pages from a JSON landing directory with a version cursor, normalised to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import author_names, year_of

CREATOR = "struct<creatorType:string,firstName:string,lastName:string,name:string>"
DATA = f"struct<itemType:string,title:string,date:string,publisher:string,institution:string,nameOfAct:string,dateEnacted:string,DOI:string,ISBN:string,url:string,abstractNote:string,linkMode:string,contentType:string,filename:string,creators:array<{CREATOR}>,tags:array<struct<tag:string>>,collections:array<string>,deleted:int>"
SCHEMA = f"key string, version long, parentItem string, data {DATA}"
CHILD_TYPES = ("note", "attachment", "annotation")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw items; unknown fields are left out, missing ones are null."""
    return spark.read.schema(SCHEMA).json(path)


def increment(items: DataFrame, cursor: int | None) -> DataFrame:
    """Items newer than the cursor; all of them (a full snapshot) without one."""
    return items if cursor is None else items.filter(F.col("version") > cursor)


def next_cursor(items: DataFrame, cursor: int | None) -> DataFrame:
    """One row: the newest version seen, never below the cursor."""
    return items.agg(F.greatest(F.lit(cursor or 0), F.coalesce(F.max("version"), F.lit(0))).alias("cursor"))


def is_document(item_type: Column) -> Column:
    return ~item_type.isin(*CHILD_TYPES)


def normalize(items: DataFrame) -> DataFrame:
    """Documents: title, date, publisher with the fields that acts and reports use instead; year, authors, tags."""
    d = F.col("data")
    kind = d["itemType"]
    filled = lambda *cols: F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])
    title = filled(d["title"], F.when(kind == "statute", d["nameOfAct"]))
    date = filled(d["date"], F.when(kind == "statute", d["dateEnacted"]))
    publisher = filled(d["publisher"], F.when(kind == "report", d["institution"]))
    return items.filter(is_document(kind)).select(
        "key", "version", kind.alias("item_type"), title.alias("title"), date.alias("date"), year_of(date).alias("year"), publisher.alias("publisher"),
        author_names(F.coalesce(d["creators"], F.array().cast(f"array<{CREATOR}>"))).alias("authors"), F.transform(F.coalesce(d["tags"], F.array().cast("array<struct<tag:string>>")), lambda t: t["tag"]).alias("tags"),
        F.coalesce(d["collections"], F.array().cast("array<string>")).alias("collections"),
    )


def attachments(items: DataFrame) -> DataFrame:
    d = F.col("data")
    return items.filter(d["itemType"] == "attachment").select("key", F.col("parentItem").alias("parent_key"), d["contentType"].alias("content_type"), d["filename"].alias("filename"), d["linkMode"].alias("link_mode"), (F.coalesce(d["deleted"], F.lit(0)) == 1).alias("deleted"))


def deleted_events(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Keys in the trash and keys that are gone for good."""
    return items.filter(F.col("data.deleted") == 1).select("key").union(removed.select("key")).distinct()
