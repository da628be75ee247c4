"""Inputs that the queries share: the test tables seen as a knowledge base, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridkb.functions import kinds, text
from hybridkb.session import table

NOW_MS = 1704067200000 + 4 * 86_400_000
DAY_MS = 86_400_000
DIM = 64
#: A query vector, as an embedder would give one.
VECTOR = [((i * 37) % 17 - 8) / 10 for i in range(DIM)]
VECTOR_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
EXTENSIONS = ["html", "md", "txt", "json"]


def tok(column: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def epoch_ms(column: str):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"cast(floor(cast(cast({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000) AS BIGINT)")


def kb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, url, kind, lang, tags, fetched_at_ms, pinned, content_hash, text) of all documents."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), epoch_ms("ts").alias("_at"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    rows = docs.join(seen, "doc_id", "left").withColumn("url", url)
    return rows.select(
        "doc_id",
        "url",
        kinds.kind_from_path(F.col("url")).alias("kind"),
        "lang",
        F.array("source", "lang").alias("tags"),
        F.coalesce("_at", F.lit(0)).cast("long").alias("fetched_at_ms"),
        (F.col("doc_id") % 10 == 0).alias("pinned"),
        F.col("n_chars").cast("long").alias("content_hash"),
        "text",
    )


KB_SQL = """kb AS (SELECT doc_id, 'https://' || source || '.example.com/' || lang || '/' || doc_id || '.' || ['html','md','txt','json'][(doc_id % 4 + 1)::INT] AS url,
  ['html','markdown','text','json'][(doc_id % 4 + 1)::INT] AS kind, lang, [source, lang] AS tags,
  coalesce(epoch_us(ts) // 1000, 0) AS fetched_at_ms, doc_id % 10 = 0 AS pinned, n_chars AS content_hash, text
  FROM documents LEFT JOIN events ON event_id = doc_id)"""

TERMS_SQL = f"docs AS (SELECT doc_id, {tok('text')}[1:4096] AS terms FROM documents)"


def term_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, terms) of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.capped_terms(F.col("text")).alias("terms"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) over all documents: three links each, loops left out."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    ends = F.array_distinct(F.array((F.col("doc_id") * 7 + 1) % F.col("n"), (F.col("doc_id") * 3 + 2) % F.col("n"), F.floor(F.col("doc_id") / 2).cast("long")))
    return ids.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("src"), F.explode(ends).alias("dst")).where("src <> dst")


EDGES_SQL = """n AS (SELECT count(*) AS n FROM documents),
edges AS (SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, unnest([(doc_id * 7 + 1) % n, (doc_id * 3 + 2) % n, doc_id // 2]) AS dst FROM documents, n) WHERE src <> dst)"""
