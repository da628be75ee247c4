"""Files under a folder as resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridkb.functions import kinds


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(url, kind, body, size, fetched_at_ms) of the indexable files below ``root``; names that tell no
    indexable kind are never read, as the filter is on the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "file:///")
    kind = kinds.kind_from_path(F.col("path"))
    rows = files.where(kinds.is_indexable(kind))
    return rows.select(path.alias("url"), kind.alias("kind"), F.col("content").alias("body"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("fetched_at_ms"))
