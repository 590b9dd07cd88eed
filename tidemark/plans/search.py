"""Question batch to ranked, admitted results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import retrieve as R
from tidemark.operators.selection import select_candidates


def search(queries: DataFrame, corpus: DataFrame, top_k: int = 5, threshold: float = 0.0, pool: int = R.POOL,
           hybrid: bool = True, floor: float = R.LOW_CONFIDENCE, quality: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """Nearest neighbours, threshold, quality filter, keyword merge, admission by priority, confidence mark.

    Admission only bites when a query has more candidates than places; otherwise all its candidates come out
    in score order, which is what the admission yields for a small pool too. Chunks without a vector are found by keywords
    only. ``terms``: a stored index by chunk.
    """
    nearest = R.vector_top_k(corpus.filter("embedding IS NOT NULL"), queries, R.pool_depth(top_k, pool))
    found = R.vector_pool(nearest, corpus, top_k, threshold, pool, quality)
    if hybrid:
        found = R.hybrid_merge(found, R.keyword_top(R.chunk_terms(corpus) if terms is None else terms, queries, R.KEYWORD_POOL), corpus, quality=quality)
    columns = ["query_id", "chunk_id", "score", "content", "source_name", "priority"]
    return R.low_confidence(select_candidates(found.select(*columns), top_k), floor)
