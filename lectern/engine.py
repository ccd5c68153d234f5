"""The service surface as calls on DataFrames: search, passages, graph browsing and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import frontmatter
from lectern.functions.text import alias_stem
from lectern.operators import graph, locate, search
from lectern.operators.model_store import ModelStore


class Engine:
    """Tables by name: chunks (chunk_id, document_id, attachment_id, chunk_index, text, snapshot_id, active), entities, mentions, relations, and vectors (chunk_id, vector) for dense search."""

    def __init__(self, tables: dict[str, DataFrame], store: ModelStore | None = None):
        """``store``: where the graph's read model is kept; without one it is computed at each call."""
        self.tables, self.store = tables, store

    def _active_chunks(self) -> DataFrame:
        return self.tables["chunks"].filter("active")

    def search(self, queries: DataFrame, top_n: int = 10, document_ids: list | None = None, cap: int = 2, query_vectors: DataFrame | None = None, graph_arm: bool = False, rerank_scores: search.Arm | None = None) -> DataFrame:
        """``queries``: query_id, text. Scope filters apply before scoring.

        The dense arm runs if ``query_vectors`` (query_id, vector) are given, against the table vectors (chunk_id, vector); the
        graph arm on request.
        """
        chunks = active = self._active_chunks()
        if document_ids is not None:
            chunks = chunks.filter(F.col("document_id").isin(*document_ids))
        docs = chunks.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("owner"), "text")
        rows = None if query_vectors is None else self.tables["vectors"].select(F.col("chunk_id").alias("id"), "vector")

        def linked(seeds: DataFrame) -> DataFrame:
            mentions = self.tables["mentions"].join(active.select("chunk_id"), "chunk_id", "left_semi")
            stable = mentions.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("n")).filter("n >= 2").select("entity_id")
            return graph.expand(seeds, mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), stable, search.fetch_count(top_n))

        return search.hybrid(queries, docs, top_n, cap, query_vectors, rows, linked if graph_arm else None, rerank_scores)

    def passage(self, ids: DataFrame) -> DataFrame:
        """``ids``: chunk_id. The chunks with the texts before and after, all of the active generation, and their state."""
        with_sides = locate.neighbors(self._active_chunks(), "attachment_id", "chunk_index", "text")
        known = self.tables["chunks"].groupBy("chunk_id").agg(F.max("active").alias("a"))
        told = F.when(F.col("a").isNull(), "unknown").when(F.col("a"), "active").otherwise("superseded")
        state = ids.join(known, "chunk_id", "left").select("chunk_id", told.alias("state"))
        return state.join(with_sides, "chunk_id", "left")

    def bound_entities(self) -> DataFrame:
        """Entities with exact aliases, then inflected ones."""
        exact = graph.bind_aliases(self.tables["entities"], self.tables["mentions"], F.col("form"))
        return graph.bind_aliases(exact.filter("alias_of IS NULL"), self.tables["mentions"], alias_stem(F.col("form"))).unionByName(exact.filter("alias_of IS NOT NULL"))

    def roots(self) -> DataFrame:
        held = self.store.read("roots") if self.store else None
        return held if held is not None else graph.roots(self.tables["entities"], self.tables["mentions"])

    def _evidence_chunks(self) -> DataFrame:
        return self._active_chunks().select("chunk_id", F.col("document_id").alias("doc_id"), (~frontmatter.is_front_matter(F.col("text"))).alias("body"))

    def model(self) -> DataFrame:
        held = self.store.read("triples") if self.store else None
        return held if held is not None else graph.read_model(self.tables["entities"], self.tables["relations"], self._evidence_chunks())

    def refresh_model(self, changed: DataFrame | None = None) -> int:
        """Bring the stored read model up to date with the tables; ``changed``: id of entities that differ, all if not given."""
        return self.store.refresh(self.tables["entities"], self.tables["mentions"], self.tables["relations"], self._evidence_chunks(), changed)

    def kg_entities(self, queries: DataFrame, **limits) -> DataFrame:
        return graph.search_entities(self.roots(), queries, **limits)

    def kg_neighbors(self, ids: DataFrame, **limits) -> DataFrame:
        return graph.neighbors(self.model(), self.roots(), ids, **limits)

    def kg_relations(self, **limits) -> DataFrame:
        return graph.browse(self.model(), self.roots(), **limits)

    def consolidate(self) -> dict[str, DataFrame]:
        parts = graph.consolidate(self.tables["entities"], self.tables["mentions"], self.tables["relations"])
        return dict(zip(("entities", "mentions", "relations", "archive"), parts, strict=True))

    def evidence_sources(self, triples: DataFrame) -> DataFrame:
        """(source, target, type, chunk_id, document_id, chunk_index, text) of the evidence of ``triples``."""
        each = triples.select("source", "target", "type", F.explode("evidence").alias("chunk_id"))
        return each.join(self._active_chunks().select("chunk_id", "document_id", "chunk_index", "text"), "chunk_id")

    def propose_gold(self, queries: DataFrame, scope: DataFrame, top_n: int = 10, **arms) -> DataFrame:
        """Search hits whose document is in a query's ``scope`` (query_id, document_id), as proposals to confirm."""
        hits = self.search(queries, top_n, **arms)
        owned = hits.join(self._active_chunks().select(F.col("chunk_id").alias("id"), "document_id"), "id")
        return owned.join(scope, ["query_id", "document_id"], "left_semi").withColumn("confirmed", F.lit(False))
