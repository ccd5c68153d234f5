"""Registry of queries and of their DuckDB counterparts, and the tables that several of them derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the test tables: (doc_id, chunk_index, chunk_id, text), one a line of a document."""
    docs = table(spark, sf_dir, "documents")
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return split.select("doc_id", "chunk_index", F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "text")


LINES = """
lines AS (SELECT doc_id, (i - 1)::INT AS chunk_index, doc_id || ':' || (i - 1) AS chunk_id, parts[i] AS text
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) u(i))"""
