"""Structured Streaming into a knowledge base: micro-batches of pages are ingested as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hybridkb.knowledge_base import PAGES, KnowledgeBase


def page_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Parquet drops of pages as a stream."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest_stream(pages: DataFrame, kb: KnowledgeBase, checkpoint: str, report: Callable[[int, DataFrame], None] | None = None, save: bool = True, **trigger):
    """A started query that ingests each batch and saves. A batch that is run again after a failure
    finds its pages unchanged, so that it adds nothing twice."""

    def one(batch: DataFrame, batch_id: int) -> None:
        changes = kb.ingest(batch)
        if save and kb.path:
            kb.save()
        if report:
            report(batch_id, changes)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
