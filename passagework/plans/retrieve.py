"""Retrieval by strategy: bm25, dense, hybrid, hybrid_rerank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from passagework.operators.rerank import rerank
from passagework.operators.retrieval import dense_search, rrf, sparse_search
from passagework.session import cut

STRATEGIES = ("bm25", "dense", "hybrid", "hybrid_rerank")


@dataclass(frozen=True)
class Index:
    """Chunks with both encodings, all three from one snapshot."""

    chunks: DataFrame
    dense: DataFrame | None = None
    postings: DataFrame | None = None


def retrieve(queries: DataFrame, index: Index, strategy: str = "hybrid", k: int = 10, *, dense_k: int = 50,
             sparse_k: int = 50, candidates: int = 25, scorer=None, stem: bool = True) -> DataFrame:
    """Ranked chunks per query. With no scorer, reranking keeps the fused order."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy == "bm25":
        return sparse_search(queries, index.postings, index.chunks, k, stem)
    if strategy == "dense":
        return dense_search(queries, index.dense, k)
    lists = {
        "dense": dense_search(queries, index.dense, dense_k),
        "sparse": sparse_search(queries, index.postings, index.chunks, sparse_k, stem),
    }
    if strategy == "hybrid" or scorer is None:
        return rrf(lists, limit=k)
    # Reranking reads its candidates several times: the searches run once.
    wide = cut(rrf(lists, limit=max(candidates, k)))
    return rerank(queries, wide, index.chunks, scorer, k)
