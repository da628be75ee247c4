"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hybridkb.llm import bpe, collision_search, html_content, metric_tree, mixing, near_duplicates, sanitise, token_files, toxicity, url_reputation
from hybridkb.session import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_token_counts(table(spark, sf_dir, "documents"))


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitise_documents(table(spark, sf_dir, "documents"))


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.approximate_neighbours(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_exact_topk": op2_exact_topk,
        "op3_token_counts": op3_token_counts,
        "op4_sanitise": op4_sanitise,
        "op5_collision_ann": op5_collision_ann,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_html_content": op7_html_content,
        "op8_toxicity": op8_toxicity,
        "op9_url_reputation": op9_url_reputation,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": metric_tree.oracle(),
        "op9_url_reputation": url_reputation.oracle(),
        "op10_ngram_jaccard_join": near_duplicates.oracle(),
    }
