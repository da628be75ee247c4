"""Repository trees: locators, the tree listing, admission and difference by object hash."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.functions import kinds, urls

ENTRY = "array<struct<path:string,type:string,sha:string,size:long>>"
_WEB = re.compile(r"https?://github\.com/")


class RepoSpec(NamedTuple):
    owner: str
    repo: str
    ref: str
    subdir: str


def is_repo_spec(text: str) -> bool:
    t = text.strip()
    return t.startswith("github:") or bool(_WEB.match(t))


def parse_repo_spec(text: str) -> RepoSpec:
    """``github:owner/repo[@ref][//dir]`` or ``https://github.com/owner/repo[.git][/tree|blob/ref[/dir]]``; a ValueError for all else."""
    t = text.strip()
    if t.startswith("github:"):
        locator, _, sub = t[7:].partition("//")
        path, at, ref = locator.partition("@")
        if at and not ref:
            raise ValueError(f"{text}: no ref after '@'")
        if not re.fullmatch(r"[^/]+/[^/]+", path):
            raise ValueError(f"{text}: not of the form owner/repo")
        return RepoSpec(*path.split("/"), ref, sub.strip("/"))
    if not _WEB.match(t) or (u := urls.parse(t)) is None:
        raise ValueError(f"no repository: {text}")
    parts = [p for p in u.path.split("/") if p]
    if len(parts) < 2 or not (repo := parts[1].removesuffix(".git")):
        raise ValueError(f"{text}: owner or repo missing")
    if len(parts) == 2:
        return RepoSpec(parts[0], repo, "", "")
    if parts[2] not in ("tree", "blob"):
        raise ValueError(f"{text}: {parts[2]} isn't tree or blob")
    if len(parts) == 3:
        raise ValueError(f"{text}: no ref")
    return RepoSpec(parts[0], repo, parts[3], "/".join(parts[4:]))


def listing(spec: RepoSpec, get: Callable[[str], dict]) -> tuple[str, str]:
    """(ref, the tree's JSON) of a repository: one request for its default branch where the spec has no ref, one for
    the whole tree. A status other than 200 is an error."""

    def asked(url: str) -> str:
        got = get(url)
        if got.get("status") != 200 or got.get("body") is None:
            raise RuntimeError(f"{url}: {got.get('error') or got.get('status')}")
        return bytes(got["body"]).decode()

    api = f"https://api.github.com/repos/{spec.owner}/{spec.repo}"
    ref = spec.ref or json.loads(asked(api))["default_branch"]
    return ref, asked(f"{api}/git/trees/{quote(ref, safe='')}?recursive=1")


def quoted_path(path: Column) -> Column:
    """A path as it stands in a URL."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def entries(responses: DataFrame) -> DataFrame:
    """(path, type, sha, size) from one tree response (column ``json``); a truncated one is an error."""
    parsed = responses.select(F.from_json("json", f"tree {ENTRY}, truncated boolean").alias("r"))
    checked = parsed.withColumn("ok", F.when(F.col("r.truncated"), F.raise_error(F.lit("the tree is truncated"))).otherwise(F.lit(True)))
    return checked.where("ok").select(F.inline("r.tree"))


def admit(tree: DataFrame, subdir: str = "", depth: int | None = None, max_bytes: int = 2 << 20, extensions: list[str] | None = None) -> DataFrame:
    """Blobs below ``subdir``, of at most ``depth`` folders below it and ``max_bytes`` (an unknown size passes), of an indexable kind and one of the extensions."""
    sub = subdir.strip("/")
    path = F.col("path")
    ok = F.col("type") == "blob"
    if sub:
        ok = ok & path.startswith(sub + "/")
    if depth is not None:
        rest = F.substring(path, F.lit(len(sub) + 2), F.length(path)) if sub else path
        ok = ok & (F.size(F.split(rest, "/")) - 1 <= depth)
    ok = ok & (F.coalesce("size", F.lit(0)) <= max_bytes) & kinds.is_indexable(kinds.kind_from_path(path))
    if extensions:
        ok = ok & urls.extension_of(path).isin([e.lstrip(".").lower() for e in extensions])
    return tree.where(ok)


def difference(admitted: DataFrame, known: DataFrame) -> DataFrame:
    """``admitted`` with ``change``: 'revalidated' where ``known`` (path, sha) has the same hash, 'changed' where it has another, else 'new'; only the
    latter two need fetching. Of a path known twice the greater hash counts."""
    k = known.groupBy("path").agg(F.max("sha").alias("_sha"))
    return admitted.join(k, "path", "left").withColumn("change", F.when(F.col("_sha").isNull(), "new").when(F.col("_sha") == F.col("sha"), "revalidated").otherwise("changed")).drop("_sha")
