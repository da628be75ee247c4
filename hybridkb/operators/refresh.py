"""Keeping documents fresh: what to evict, what to fetch again, and what a fetch leads to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GONE = (401, 403, 404, 410)
RETRIABLE = (408, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class RefreshOptions:
    ttl_ms: int = 86_400_000
    max_age_ms: int | None = None
    evict_unreachable: bool = True
    urls: list[str] | None = field(default=None)


def is_retriable(status: Column) -> Column:
    """No answer at all, and statuses that may pass."""
    return status.isNull() | status.isin(*RETRIABLE)


def plan(docs: DataFrame, now_ms: int, options: RefreshOptions = RefreshOptions()) -> DataFrame:
    """``docs`` with ``action``: 'evict' (over age and not pinned; tested first), 'fetch' (as old as the
    time to live or older) or 'fresh'. An unknown fetch time, 0, is as old as can be."""
    age = F.greatest(F.lit(now_ms) - F.coalesce("fetched_at_ms", F.lit(0)), F.lit(0))
    old = F.lit(False) if options.max_age_ms is None else (age > options.max_age_ms) & ~F.coalesce("pinned", F.lit(False))
    if options.urls is not None:
        from hybridkb.functions.urls import url_key

        keys = [k for u in options.urls if (k := url_key(u)) is not None]
        docs = docs.where(F.col("url_key").isin(keys)) if keys else docs.where(F.lit(False))
    return docs.withColumn("action", F.when(old, "evict").when(age >= options.ttl_ms, "fetch").otherwise("fresh"))


def fetch_class(status: Column) -> Column:
    return F.when(status == 304, "not_modified").when(status.isin(*GONE), "gone").when((status >= 200) & (status < 300), "changed").otherwise("transient")


def outcomes(planned: DataFrame, fetched: DataFrame, options: RefreshOptions = RefreshOptions()) -> DataFrame:
    """(url_key, action, change) of ``planned`` rows given ``fetched`` (url_key, status, content_hash,
    n_terms): change is removed, unchanged, refreshed, failed, or null for fresh rows.

    The action tells what is done: evict, touch (not modified, or an identical body), reindex, keep
    (a body that distils to nothing is kept as it was), gone, gone_kept (pinned or eviction off: failed), or retry.
    """
    f = fetched.select("url_key", "status", F.col("content_hash").alias("_new"), F.col("n_terms").alias("_terms"))
    rows = planned.join(f, "url_key", "left")
    kind = fetch_class(F.col("status"))
    keep = F.coalesce("pinned", F.lit(False)) | F.lit(not options.evict_unreachable)
    same = F.col("_new").eqNullSafe(F.col("content_hash"))
    action = (
        F.when(F.col("action") == "evict", "evict")
        .when(F.col("action") == "fresh", "fresh")
        .when(kind == "not_modified", "touch")
        .when((kind == "changed") & same, "touch")
        .when((kind == "changed") & (F.col("_terms") == 0), "keep")
        .when(kind == "changed", "reindex")
        .when((kind == "gone") & ~keep, "gone")
        .when(kind == "gone", "gone_kept")
        .otherwise("retry")
    )
    change = {"evict": "removed", "touch": "unchanged", "keep": "unchanged", "reindex": "refreshed", "gone": "removed", "gone_kept": "failed", "retry": "failed"}
    told = F.lit(None).cast("string")
    for a, c in change.items():
        told = F.when(F.col("action") == a, c).otherwise(told)
    return rows.withColumn("action", action).select("url_key", "action").withColumn("change", told)
