"""Reciprocal rank fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankParams:
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    rrf_k: int = 60
    candidate_multiplier: int = 10
    graph_boost: float = 0.0

    def pool(self, limit: int) -> int:
        return max(limit * max(self.candidate_multiplier, 1), limit, 32)


def rrf(dense: DataFrame, sparse: DataFrame, limit: int, params: RankParams = RankParams()) -> DataFrame:
    """(query_id, doc_id, score, rank) from two (query_id, doc_id, rank) lists: the weighted sum of
    1 / (k + rank), ties by doc_id."""
    parts = [
        d.select("query_id", "doc_id", (F.lit(float(w)) / (params.rrf_k + F.col("rank"))).alias("part"))
        for d, w in ((dense, params.dense_weight), (sparse, params.sparse_weight))
    ]
    fused = parts[0].unionByName(parts[1]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
