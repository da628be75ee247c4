"""Breadth-first crawl over a site table, level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridkb.functions import html, kinds, markdown, urls
from hybridkb.functions.udf import arrow_function
from hybridkb.operators.store import in_order
from hybridkb.session import discard, materialise


#: Keys of a frontier that are sent to the site at most; for more, both are shuffled.
SENT_KEYS = 1_000_000
#: Links found in a level that one task may put in order.
ONE_TASK = 1 << 18


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 2
    max_pages: int = 1000
    max_bytes: int = 2 << 20
    scope: str = "path"
    allow: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    require_path: list[str] = field(default_factory=list)
    index_path: list[str] = field(default_factory=list)
    concurrency: int = 8
    retries: int = 2
    min_delay_ms: int = 0
    user_agent: str | None = None


def backoff_ms(attempt: int, retry_after_ms: int | None = None) -> int:
    """The wait before a further attempt: what the server asked, 30 s at most, or 250 ms doubled each time."""
    return min(retry_after_ms, 30_000) if retry_after_ms is not None else 250 * 2**attempt


@arrow_function("long")
def backoff_udf(attempt: pd.Series, retry_after_ms: pd.Series) -> pd.Series:
    return pd.Series([backoff_ms(int(a), None if pd.isna(r) else int(r)) for a, r in zip(attempt, retry_after_ms)], dtype="int64")


def hrefs(kind: str | None, body) -> list[str]:
    """The links of a page as they are written, by kind; kinds other than html and markdown have none."""
    if kind == "html":
        return html.extract_links(html._text(body))
    return markdown.markdown_links(markdown.front_matter(html._text(body))[1]) if kind == "markdown" else []


@arrow_function("struct<pos:array<int>,dst:array<string>,key:array<long>>")
def links_udf(url: pd.Series, kind: pd.Series, body: pd.Series, children: pd.Series) -> pd.DataFrame:
    """Positions, URLs and keys of a page's http(s) links, resolved against ``url``, and of lists of known children."""

    def one(u, k, b, lists):
        out = []
        if b is not None and not isinstance(b, float):
            base = urls.parse(u)
            for i, h in enumerate(hrefs(k, b)):
                to = urls.resolve(base, h) if base else urls.parse(h)
                if to and to.scheme in ("http", "https"):
                    out.append((i, to.text(fragment=False)))
        for known in [] if lists is None else lists:
            out += [(i, c) for i, c in enumerate(known) if c is not None]
        return [i for i, _ in out], [x for _, x in out], [urls.url_key(x) for _, x in out]

    return pd.DataFrame([one(*x) for x in zip(url, kind, body, children)], columns=["pos", "dst", "key"])


def _among(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """What ``rows`` have of ``n`` keys: those are sent to the rows, which a join of both would shuffle whole."""
    return rows.join(F.broadcast(keys), "url_key", "left_semi") if n <= SENT_KEYS else rows


def _budget(level: DataFrame, rest: int, found: int) -> DataFrame:
    """The first ``rest`` of ``found`` successes in discovery order, and what lies before the last of them."""
    if found < rest:
        return level
    last = level.where("ok").select("place").orderBy("place").limit(rest).agg(F.max("place")).first()[0]
    return level.where(F.col("place") <= last)


def _fetched(frontier: DataFrame, fetcher: Callable[[DataFrame], DataFrame], validators: DataFrame | None, left: int) -> DataFrame:
    """The frontier with what ``fetcher`` answered, asked in order of discovery until ``left`` pages have come."""
    asked = frontier.join(validators.select("url_key", F.col("etag").alias("_known")), "url_key", "left") if validators is not None else frontier.withColumn("_known", F.lit(None).cast("string"))
    asked = materialise(asked, "crawl-frontier")
    out, at, n = None, 0, asked.count()
    while at < n and left > 0:
        step = max(left, 256)
        part = asked.where((F.col("place") >= at) & (F.col("place") < at + step))
        got = materialise(fetcher(part.select("url", F.col("_known").alias("etag"))), "crawl-fetched")
        out = got if out is None else out.unionByName(got)
        left -= got.where("status BETWEEN 200 AND 299").count()
        at += step
    kind = kinds.refine_kind(kinds.kind_from_content_type(F.col("content_type")), F.coalesce("final_url", "url"))
    answers = out.select("url", "status", "etag", "final_url", "body", kind.alias("kind"))
    return asked.select("url", "url_key", "place").join(answers, "url")


def crawl(
    site: DataFrame | None,
    root: str,
    config: CrawlConfig = CrawlConfig(),
    validators: DataFrame | None = None,
    known_edges: DataFrame | None = None,
    robots: DataFrame | None = None,
    fetcher: Callable[[DataFrame], DataFrame] | None = None,
    spark: SparkSession | None = None,
    bodies: bool = False,
) -> DataFrame:
    """(url, url_key, depth, place, outcome, yielded) of a breadth-first crawl from ``root``.

    ``site`` (url, kind, body, status, etag[, final_url, url_key]) answers the fetches; a URL that it lacks is a failure.
    ``validators`` (url_key, etag): a page whose etag is the known one is 'revalidated'; it takes no page
    budget, and its children come from ``known_edges`` (url_key, children). ``robots`` (host, path)
    are disallowed prefixes. Outcomes: fetched, revalidated, failed. ``yielded`` is false where only the
    links are followed (extension, index path). A root that fails raises an error. Without ``site`` each level is
    asked of ``fetcher``, a function from (url, etag) to ``fetch.FETCHED`` rows, which sends known etags along (304 is
    'revalidated'). ``bodies`` adds kind, body and etag.

    The site is keyed and written once, its known etags beside it; each level sends its keys there and joins what it has of
    them. A level is written with its links, read and keyed in one pass of Python, or, where the page budget may end within
    it, with its bodies. Children keep the least (place of parent, position) at which they are found, and those seen before
    are anti-joined; few links are put in order by one task, more by range. What is shuffled of a level grows with its pages
    and with the keys seen, not with the site.
    """
    spark = spark or site.sparkSession
    parsed = urls.parse(root)
    if parsed is None:
        raise ValueError(f"not a URL: {root}")
    start = parsed.text(fragment=False)
    if site is not None:
        keyed = site if "url_key" in site.columns else site.withColumn("url_key", urls.url_key_udf("url"))
        pages = keyed.select("url_key", F.col("url").alias("site_url"), "kind", "body", "status", "etag", (F.col("final_url") if "final_url" in site.columns else F.lit(None).cast("string")).alias("final_url"))
        if validators is not None:
            pages = pages.join(validators.select("url_key", F.col("etag").alias("_known")), "url_key", "left")
        if config.max_depth:
            pages = materialise(pages, "crawl-site")
    if known_edges is not None and config.max_depth:
        known_edges = materialise(known_edges.select("url_key", "children"), "crawl-edges")
    frontier = spark.createDataFrame([(start, urls.url_key(start), 0)], "url string, url_key long, place long")
    keys, n = frontier.select("url_key"), 1  # n: as many as the frontier has, or more
    paths: list[str] = []
    extra = ["kind", "body", "etag"] if bodies else []
    left = config.max_pages
    root_col = F.lit(start)
    for depth in range(config.max_depth + 1):
        level = frontier.join(_among(pages, keys, n), "url_key", "left") if site is not None else _fetched(frontier, fetcher, validators, left)
        good = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False)) & (F.coalesce(F.octet_length("body"), F.lit(0)) <= config.max_bytes)
        same = F.lit(False)
        if validators is not None:
            if site is None:
                level = level.join(validators.select("url_key", F.col("etag").alias("_known")), "url_key", "left")
            same = F.coalesce(F.col("_known") == F.col("etag"), F.lit(False)) if site is not None else F.coalesce(F.col("status") == 304, F.lit(False))
        effective = F.coalesce("final_url", "url")
        level = level.withColumn("effective", effective)
        if depth:
            good = good & urls.in_scope(root_col, F.col("effective"), config.scope, config.allow)
        if robots is not None:
            level = level.withColumn("_host", urls.host_of(F.col("url"))).join(robots.groupBy(F.col("host").alias("_host")).agg(F.collect_list("path").alias("_no")), "_host", "left")
            barred = F.coalesce(F.exists("_no", lambda p: urls.url_path(F.col("url")).startswith(p)), F.lit(False))
            good = good & ~barred
        level = level.withColumns({"outcome": F.when(good & same, "revalidated").when(good, "fetched").otherwise("failed"), "ok": good & ~same})
        moved = F.col("url_key")
        if site is None or "final_url" in site.columns:
            moved = F.when(F.col("effective") == F.col("url"), F.col("url_key")).otherwise(urls.url_key_udf("effective"))
        level = level.select("url", "url_key", "place", "effective", "kind", "body", "etag", "outcome", "ok", moved.alias("_moved")).withColumn("depth", F.lit(depth))
        followed, whole = depth < config.max_depth, n < left
        if followed and known_edges is not None:
            known = _among(known_edges, keys, n).groupBy("url_key").agg(F.collect_list("children").alias("_children"))
            level = level.join(known, "url_key", "left").withColumn("_children", F.when(F.col("outcome") == "revalidated", F.col("_children")))
        else:
            level = level.withColumn("_children", F.lit(None).cast("array<array<string>>"))
        links = links_udf("effective", "kind", F.when(F.col("ok"), F.col("body")), "_children").alias("links")
        kept = ["url_key", "place", "effective", "outcome", "ok", "_moved", "depth"]
        if followed:
            kept += [links, *extra] if whole else ["kind", "body", "etag", "_children"]
        else:
            kept += extra
        level = materialise(level.select(*kept), f"crawl-{depth}")
        paths.append(level._scratch_path)
        number = F.sum(F.size("links.pos")) if followed and whole else F.lit(None)
        good_pages, failed, n_links = level.agg(F.count_if("ok"), F.count_if(F.col("outcome") == "failed"), number).first()
        if depth == 0 and failed:
            raise RuntimeError(f"the root can't be fetched: {start}")
        level = _budget(level, left, good_pages)
        left -= min(left, good_pages)
        if not followed or left <= 0:
            break
        found = level if whole else level.withColumn("links", links)
        found = found.select(F.col("place").alias("_from"), F.inline(F.arrays_zip("links.pos", "links.dst", "links.key")).alias("pos", "url", "url_key"))
        found = found.where(~urls.is_asset(F.col("url")) & urls.in_scope(root_col, F.col("url"), config.scope, config.allow) & urls.path_allowed(F.col("url"), config.require_path))
        seen = spark.read.schema("url_key long, _moved long").parquet(*paths).select(F.explode(F.array_distinct(F.array("url_key", "_moved"))).alias("url_key"))
        first = found.groupBy("url_key").agg(F.min(F.struct("_from", "pos", "url")).alias("f")).join(seen, "url_key", "left_anti")
        first, order = first.select("f.url", "url_key", "f._from", "f.pos"), ["_from", "pos", "url"]
        if n_links is not None and n_links <= ONE_TASK:
            placed = first.repartition(1).sortWithinPartitions(*order).select("url", "url_key", F.monotonically_increasing_id().alias("place"))
            frontier, n = materialise(placed, f"crawl-found-{depth}"), n_links
            keys = frontier.select("url_key")
            if frontier.isEmpty():
                break
        else:
            first = materialise(first, f"crawl-found-{depth}")
            keys, n = first.select("url_key"), first.count()
            if not n:
                break
            frontier = in_order(first, order, "place").select("url", "url_key", "place")
    shown = urls.extension_allowed(F.col("effective"), config.extensions) & urls.path_allowed(F.col("effective"), config.index_path)
    columns = [F.col("effective").alias("url"), "url_key", "depth", "place", "outcome", (F.col("ok") & shown).alias("yielded"), *extra]
    before = [spark.read.schema(level.drop("links", "_children").schema).parquet(*paths[:-1])] if len(paths) > 1 else []
    out = level.select(*columns)
    for x in before:
        out = x.select(*columns).unionByName(out)
    if site is not None and config.max_depth:
        discard(pages)
    return out
