"""Hybrid search: prefilter, dense and sparse pools, reciprocal rank fusion, graph boost, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.operators import bm25, dense, fusion, graph
from hybridkb.operators.filters import Filter, everything

HIT = ["query_id", "rank", "url", "score", "title", "snippet", "kind", "tags"]


def hybrid(
    docs: DataFrame,
    vecs: DataFrame,
    post: DataFrame,
    stats: DataFrame,
    queries: DataFrame,
    k: int = 10,
    where: Filter | None = None,
    params: fusion.RankParams = fusion.RankParams(),
    edges: DataFrame | None = None,
    metric: str = "cosine",
) -> DataFrame:
    """(query_id, doc_id, score, rank) for ``queries`` (query_id, vector, terms).

    The filter restricts both arms; term statistics are those of all documents. The dense arm admits
    each allowed document whatever its score. Metadata is joined by ``hits`` after the ranking.
    """
    where = where or everything()
    allowed = None if where.trivial else where.apply(docs).select("doc_id")
    pool = params.pool(k)
    near = dense.batch_top_k(vecs if allowed is None else vecs.join(allowed, "doc_id", "left_semi"), queries, pool, metric)
    terms = queries.select("query_id", F.explode("terms").alias("term"))
    sparse = bm25.top_k(bm25.score(post, stats, terms, allowed), pool)
    boost = params.graph_boost > 0 and edges is not None
    fused = fusion.rrf(near, sparse, pool if boost else k, params)
    return graph.boosted(fused, edges, params.graph_boost, k) if boost else fused


def hits(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked rows with their metadata; only as many documents are read out as were ranked."""
    meta = docs.select("doc_id", "url", "title", "snippet", "kind", "tags")
    return meta.join(ranked, "doc_id").select(*HIT)
