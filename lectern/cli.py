"""Maintenance commands for spark-submit: each reads tables from a folder and reports; ``--apply`` writes the result beside it.

python -m lectern.cli FOLDER {consolidate,bind-aliases,normalize-types,collapse-relations,read-model} [--apply OUT]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.operators import graph


def results(engine: Engine, command: str) -> dict[str, DataFrame]:
    """The tables that a command makes."""
    t = engine.tables
    if command == "consolidate":
        return engine.consolidate()
    if command == "bind-aliases":
        return {"entities": engine.bound_entities()}
    if command == "normalize-types":
        return {"entities": graph.normalize_types(t["entities"])}
    if command == "collapse-relations":
        return {"relations": graph.collapse_relations(t["relations"])}
    if command == "read-model":
        return {"roots": engine.roots(), "triples": engine.model()}
    raise ValueError(command)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=("consolidate", "bind-aliases", "normalize-types", "collapse-relations", "read-model"))
    parser.add_argument("--apply", metavar="OUT")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    tables = {n: spark.read.parquet(f"{given.folder}/{n}") for n in ("chunks", "entities", "mentions", "relations")}
    for name, df in results(Engine(tables), given.command).items():
        print(name, df.agg(F.count("*")).first()[0])
        if given.apply:
            df.write.mode("errorifexists").parquet(f"{given.apply}/{name}")


if __name__ == "__main__":
    main()
