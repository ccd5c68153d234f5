"""Connected components of links, on the executors only: hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, with_group_facts


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Edges lead from a node to smaller ones. A round joins all smaller neighbours of a node to the least of them, its parent,
    and then moves every edge's end to that end's parent. It is over when every node has one parent and no parent has one
    itself: for links that already are stars, without any round. A node that many edges begin or end at is hot in neither
    step: parents are summed before they shuffle, and edges meet parents through ``with_group_facts``. Rounds grow with the
    logarithm of the longest path. Each round is cut into the shared folder. Null ends give no link; no links give no rows.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while True:
        parents = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        total, most = parents.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        up = parents.select(F.col("u").alias("v"), F.col("m").alias("w"))
        if most <= 1 and parents.select(F.col("m").alias("v")).distinct().join(up, "v", "left_semi").isEmpty():
            return parents.select(F.col("u").alias("node"), F.col("m").alias("component")).union(parents.select("m", "m").distinct())
        hooked = parents.select("u", F.col("m").alias("v"))
        if most > 1:
            hooked = hooked.union(with_group_facts(edges, parents, "u", "n", total, ["v"]).filter("n > 1 AND v != m").select("v", "m"))
        ends = hooked.groupBy("v").agg(F.count("*").alias("n")).join(up, "v").select("v", "n", "w")
        edges = cut(with_group_facts(hooked, ends, "v", "n", total, ["u"]).select("u", F.coalesce("w", "v").alias("v")).distinct())
