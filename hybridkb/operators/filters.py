"""Structured prefilters over document metadata: two-valued, so that a null never makes a row vanish
under negation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridkb.functions.urls import url_path


class Filter:
    """A condition on (url, kind, lang, tags, fetched_at_ms); combine with &, | and ~."""

    def __init__(self, condition: Column | None = None):
        self.condition = condition

    def column(self) -> Column:
        return F.lit(True) if self.condition is None else F.coalesce(self.condition, F.lit(False))

    @property
    def trivial(self) -> bool:
        return self.condition is None

    def apply(self, docs):
        return docs if self.trivial else docs.where(self.column())

    def __and__(self, other: Filter) -> Filter:
        return Filter(self.column() & other.column())

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.column() | other.column())

    def __invert__(self) -> Filter:
        return Filter(~self.column())


def everything() -> Filter:
    return Filter()


def tag(value: str) -> Filter:
    return Filter(F.array_contains("tags", value))


def lang(value: str) -> Filter:
    return Filter(F.col("lang") == value)


def path_prefix(prefix: str) -> Filter:
    """A raw prefix of the path, without regard to '/'."""
    return Filter(url_path(F.col("url")).startswith(prefix))


def kind(value: str) -> Filter:
    return Filter(F.col("kind") == value)


def fetched_before(ms: int) -> Filter:
    return Filter(F.col("fetched_at_ms") < ms)


def fetched_after(ms: int) -> Filter:
    return Filter(F.col("fetched_at_ms") >= ms)


def all_of(filters: list[Filter]) -> Filter:
    return reduce(lambda a, b: a & b, filters) if filters else everything()
