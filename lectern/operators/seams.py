"""Where models plug in: embedding, reranking, entities. A model is a function on a list of texts, loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED_BATCH, RERANK_MOST = 16, 64


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[tuple[list[float], dict[str, float]]]]], dimensions: int) -> DataFrame:
    """(key, embedding, sparse). A batch that fails gets zero vectors and empty maps, which match nothing; a wrong size fails."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            out: list[tuple[list[float], dict[str, float]]] = []
            for a in range(0, len(frame), EMBED_BATCH):
                texts = frame[text].iloc[a : a + EMBED_BATCH].tolist()
                try:
                    got = model(texts)
                except Exception:  # noqa: BLE001  a model may raise anything
                    got = [([0.0] * dimensions, {}) for _ in texts]
                if len(got) != len(texts) or any(len(v) != dimensions for v, _ in got):
                    raise ValueError("the model's vectors don't fit")
                out += got
            yield pd.DataFrame({key: frame[key], "embedding": [v for v, _ in out], "sparse": [s for _, s in out]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>, sparse map<string,double>")


def rerank_scores(pairs: DataFrame, load: Callable[[], Callable[[str, list[str]], list[float]]]) -> DataFrame:
    """(query_id, id, rerank) of (query_id, id, query, text), at most RERANK_MOST a query."""
    kinds = dict(pairs.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > RERANK_MOST:
            raise ValueError(f"a query has at most {RERANK_MOST} candidates")
        return pd.DataFrame({"query_id": frame["query_id"], "id": frame["id"], "rerank": load()(frame["query"].iloc[0], frame["text"].tolist())})

    return pairs.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, rerank double")


def named_entities(found: DataFrame) -> DataFrame:
    """(chunk_id, text, type, confidence, mentions) from a model's rows (chunk_id, text, type, start, confidence), filtered and grouped."""
    from lectern.operators.extract import keep_entity

    good = found.filter(keep_entity(F.col("text")))
    return good.groupBy("chunk_id", "text", "type").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("start")).alias("mentions"))
