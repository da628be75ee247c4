"""The link graph: resolution, neighbours, related pages, boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(docs: DataFrame) -> DataFrame:
    """(src, dst) by doc_id from (doc_id, url_key, edges): dangling links and loops are left out."""
    out = docs.select(F.col("doc_id").alias("src"), F.explode("edges").alias("key"))
    return out.join(docs.select(F.col("url_key").alias("key"), F.col("doc_id").alias("dst")), "key").where("src <> dst").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(doc_id, out_degree, in_degree) of the documents with an edge."""
    both = edges.select(F.col("src").alias("doc_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    return both.groupBy("doc_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def related(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, doc_id, score, rank): 2 for each edge from the seed, 1 for each path through a page that
    links to both; the k best of each seed, ties by doc_id. Seeds outside the graph give nothing."""
    s = seeds.select(F.col("doc_id").alias("seed")).distinct()
    direct = edges.join(s, edges.src == s.seed).select("seed", F.col("dst").alias("doc_id"), F.lit(2).alias("w"))
    parents = edges.join(s, edges.dst == s.seed).select("seed", F.col("src").alias("parent"))
    siblings = parents.join(edges, parents.parent == edges.src).where("dst <> seed").select("seed", F.col("dst").alias("doc_id"), F.lit(1).alias("w"))
    scores = direct.unionAll(siblings).groupBy("seed", "doc_id").agg(F.sum("w").alias("score"))
    w = Window.partitionBy("seed").orderBy(F.desc("score"), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def boosted(candidates: DataFrame, edges: DataFrame, weight: float, limit: int) -> DataFrame:
    """``candidates`` (query_id, doc_id, score) with ``weight`` times the mean score of their neighbours
    among them added (a mutual link counts twice), ranked anew. A weight of 0 or less leaves the scores."""
    scored = candidates.select("query_id", "doc_id", "score")
    if weight > 0:
        around = edges.unionAll(edges.select("dst", "src"))
        ids = scored.select(F.col("doc_id").alias("src")).distinct()
        near = around.join(ids, "src", "left_semi").join(scored.select("query_id", F.col("doc_id").alias("dst"), F.col("score").alias("theirs")), "dst")
        mean = near.groupBy("query_id", F.col("src").alias("doc_id")).agg(F.avg("theirs").alias("mean"))
        scored = scored.join(mean, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + weight * F.coalesce("mean", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
