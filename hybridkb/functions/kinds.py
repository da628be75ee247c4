"""Kinds of resources, from content types and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = {"html": 0, "markdown": 1, "code": 2, "text": 3, "pdf": 4, "json": 5, "unknown": 255}
_MIME = {"html": ["application/xhtml+xml", "text/html"], "markdown": ["text/x-markdown", "text/markdown"], "json": ["text/json", "application/json"], "pdf": ["application/pdf"], "text": ["text/plain"]}
_EXT = {
    "html": ["htm", "html", "xhtml"],
    "markdown": ["markdown", "md", "mdx"],
    "json": ["json"],
    "pdf": ["pdf"],
    "text": ["text", "txt"],
    "code": ["c", "cpp", "go", "h", "hpp", "java", "js", "py", "rb", "rs", "sh", "sql", "toml", "ts", "yaml", "yml"],
}


def kind_from_content_type(value: Column) -> Column:
    """By the type before ';'; other text/* is code; null and all else unknown."""
    mime = F.lower(F.trim(F.regexp_extract(F.coalesce(value, F.lit("")), r"^([^;]*)", 1)))
    out = F.when(mime.isin(_MIME["html"]), "html")
    for kind in ("markdown", "json", "pdf", "text"):
        out = out.when(mime.isin(_MIME[kind]), kind)
    return out.when(mime.startswith("text/"), "code").otherwise("unknown")


def kind_from_path(path: Column) -> Column:
    """By the text after the last '.' of the last segment; a name without '.' is its own extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^./]*)$", 1))
    out = F.when(ext.isin(_EXT["html"]), "html")
    for kind in ("markdown", "json", "pdf", "text", "code"):
        out = out.when(ext.isin(_EXT[kind]), kind)
    return out.otherwise("unknown")


def refine_kind(kind: Column, path: Column) -> Column:
    """Text and unknown give way to a kind that the path tells."""
    by_path = kind_from_path(path)
    return F.when(kind.isin("text", "unknown") & (by_path != "unknown"), by_path).otherwise(kind)


def is_indexable(kind: Column) -> Column:
    return ~kind.isin("pdf", "unknown")


def is_linkable(kind: Column) -> Column:
    return kind.isin("html", "markdown")


def kind_tag(kind: Column) -> Column:
    out = F.lit(TAGS["unknown"])
    for k, v in TAGS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def kind_from_tag(tag: Column) -> Column:
    out = F.lit("unknown")
    for k, v in TAGS.items():
        out = F.when(tag == v, k).otherwise(out)
    return out


def path_kind(path: str) -> str:
    """``kind_from_path`` for one path on the driver."""
    ext = path.rsplit("/", 1)[-1].lower().rsplit(".", 1)[-1]
    return next((k for k, v in _EXT.items() if ext in v), "unknown")
