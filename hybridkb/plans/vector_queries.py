"""Queries over ``embeddings``: similarity, quantisation, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.functions import vectors as v
from hybridkb.operators import dense
from hybridkb.plans.catalog import register
from hybridkb.plans.common import DIM, VECTOR, VECTOR_SQL, vectors

_E = "embedding::DOUBLE[]"
_L2 = f"-list_sum(list_transform(list_zip({_E}, {VECTOR_SQL}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_DOT = f"list_dot_product({_E}, {VECTOR_SQL})"


def _top_sql(score: str, where: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id AS doc_id, round({score}, 6) AS score FROM embeddings WHERE {where} ORDER BY {score} DESC, vec_id LIMIT {k}"


def _top(spark, sf_dir, metric, allowed=None):
    return dense.top_k(vectors(spark, sf_dir), VECTOR, 10, metric, allowed).withColumn("score", F.round("score", 6))


@register("dense_topk_cosine", _top_sql(_DOT))
def dense_topk_cosine(spark, sf_dir):
    return _top(spark, sf_dir, "cosine")


@register("dense_topk_dot", _top_sql(_DOT))
def dense_topk_dot(spark, sf_dir):
    return _top(spark, sf_dir, "dot")


@register("dense_topk_l2", _top_sql(_L2))
def dense_topk_l2(spark, sf_dir):
    return _top(spark, sf_dir, "l2")


@register("dense_topk_filtered", _top_sql(_DOT, "label = 3"))
def dense_topk_filtered(spark, sf_dir):
    allowed = vectors(spark, sf_dir).where("label = 3").select("doc_id")
    return _top(spark, sf_dir, "cosine", allowed)


def label_means(spark, sf_dir):
    """(query_id, vector): the mean vector of each label."""
    parts = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector")).select(F.col("label").cast("long").alias("query_id"), "vector")


_MEANS = "means AS (SELECT query_id, list(x ORDER BY i) AS vector FROM (SELECT label::BIGINT AS query_id, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY query_id)"


@register("dense_topk_batch", f"WITH {_MEANS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, vec_id AS doc_id, list_dot_product({_E}, vector) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM embeddings, means) WHERE rank <= 10")
def dense_topk_batch(spark, sf_dir):
    return dense.batch_top_k(vectors(spark, sf_dir), label_means(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@register("l2_normalize", f"SELECT vec_id, round(sqrt(list_dot_product({_E}, {_E})), 6) AS norm, round(list_sum({_E}) / sqrt(list_dot_product({_E}, {_E})), 6) AS unit_sum FROM embeddings")
def l2_normalize(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), v.norm(F.col("embedding")).alias("norm"), v.l2_normalize(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round("norm", 6).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


_HAMMING = f"list_sum(list_transform(list_zip({_E}, {VECTOR_SQL}), lambda p: ((p[1] >= 0) <> (p[2] >= 0))::INT))::BIGINT"


def _signed(spark, sf_dir):
    return dense.quantise(vectors(spark, sf_dir), DIM)


@register("binary_quant_hamming", f"SELECT vec_id AS doc_id, {_HAMMING} AS distance FROM embeddings")
def binary_quant_hamming(spark, sf_dir):
    words = [sum(1 << i for i, x in enumerate(VECTOR) if x >= 0)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    return _signed(spark, sf_dir).select("doc_id", v.hamming(F.col("signs"), F.array(*[F.lit(w).cast("long") for w in words])).alias("distance"))


@register("binary_shortlist", f"SELECT vec_id AS doc_id, {_HAMMING} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 64")
def binary_shortlist(spark, sf_dir):
    return dense.shortlist(_signed(spark, sf_dir), VECTOR, 64)


_NORM = sum(x * x for x in VECTOR) ** 0.5


@register("two_tier_search", f"WITH s AS (SELECT vec_id, embedding FROM embeddings ORDER BY {_HAMMING}, vec_id LIMIT 64) SELECT vec_id AS doc_id, round({_DOT} / {_NORM}, 6) AS score FROM s ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def two_tier_search(spark, sf_dir):
    return dense.two_tier(_signed(spark, sf_dir), VECTOR, 10, 64).withColumn("score", F.round("score", 6))


@register("int8_quant_dot", f"WITH s AS (SELECT vec_id, {_E} AS e, list_max(list_transform(e, lambda x: abs(x))) AS top, CASE WHEN top > 0 THEN top / 127 ELSE 1 END AS scale FROM embeddings) SELECT vec_id AS doc_id, round(scale, 9) AS scale, list_sum(list_transform(e, lambda x: abs(round(x / scale))))::BIGINT AS code_sum, round(list_dot_product(list_transform(e, lambda x: round(x / scale)), {VECTOR_SQL}) * scale, 6) AS score FROM s")
def int8_quant_dot(spark, sf_dir):
    q = _signed(spark, sf_dir)
    dots = v.int8_dot(F.col("codes"), F.col("scale"), F.array(*[F.lit(x) for x in VECTOR]))
    return q.select("doc_id", F.round("scale", 9).alias("scale"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("code_sum"), F.round(dots, 6).alias("score"))
