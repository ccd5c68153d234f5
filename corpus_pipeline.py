"""From raw documents to packed training sequences: five stages over all rows, each written as Parquet and read again.

Language ID drops documents without a recognisable language, quality rules drop those that break a rule, exact and near
deduplication keep one document of each group, and best-fit packing places what is left in sequences of 1024 tokens.

Null and empty texts have no language and go in the first stage. Very long texts pass every stage whole. Ties: of equal texts the
largest doc_id stays, of near ones the smallest. Rows that repeat an id with its text are one document and stay or go together;
rows without an id stay. An empty table gives an empty result. All columns of documents, and others of any name, reach the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, langid, minhash, packing, quality
from lectern.llm.common import filter_rows, free_name, fresh_dir

#: Language ID rejects ``und`` and scores below this; chance is 1 / languages.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~langid.held_out()))
    name, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, model, names=(name, score))
    return found.filter((F.col(name) != "und") & (F.col(score) >= LEAST_SCORE)).drop(name, score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_rows(docs, ["doc_id", "text"], lambda d: exact_dedup.annotate(d).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, k=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("best_fit_packing", best_fit_packing),
]
#: The model, the sketches and the tokenizer can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
