"""The store's handle: update from pages, sites, files or repository trees; refresh; search; related.

    kb = KnowledgeBase.open_or_create(spark, path)
    kb.update("https://docs.example.com/", site=site_table)
    kb.search("private service connect", k=5).show()
    kb.save()
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridkb.functions import distil as d
from hybridkb.functions import kinds, urls
from hybridkb.functions.embed import HashEmbedder, embed_udf
from hybridkb.functions.vectors import l2_normalize
from hybridkb.operators import bm25, filters, graph, refresh, search, store
from hybridkb.operators.fusion import RankParams
from hybridkb.session import materialise
from hybridkb.sources import crawl as crawler
from hybridkb.sources import fetch, files, tree
from hybridkb.sources.auth import StaticToken

DOCUMENT = (
    "doc_id long, url_key long, url string, kind string, content_hash long, title string, snippet string, lang string, tags array<string>, "
    "terms array<string>, embedding array<float>, edges array<long>, fetched_at_ms long, etag string, pinned boolean"
)
PAGES = "url string, kind string, body binary, etag string"
SCOPES = {None: "path", "path": "path", "host": "host", "same_host": "host", "subdomains": "subdomains"}


class DimensionMismatch(ValueError):
    pass


class KnowledgeBase:
    """Documents by canonical URL, on a cluster. ``spark.checkpoint.dir`` holds what lies between saves."""

    def __init__(self, spark: SparkSession, path: str | None = None, embedder=None, metric: str = "cosine", extractors: tuple = ()):
        self.spark, self.path, self.metric, self.extractors = spark, path, metric, tuple(extractors)
        self.embedder = embedder or HashEmbedder()
        self.docs = spark.createDataFrame([], DOCUMENT)
        self._snapshot: dict | None = None

    # -- storage

    @classmethod
    def in_memory(cls, spark: SparkSession, **options) -> KnowledgeBase:
        return cls(spark, None, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> KnowledgeBase:
        kb = cls(spark, path, **options)
        manifest, tables = store.Snapshots(spark, path).load()
        if manifest["dim"] != kb.embedder.dim or manifest["embedder_id"] != str(getattr(kb.embedder, "embedder_id", "")):
            raise DimensionMismatch(f"saved with another embedder of dimension {manifest['dim']}")
        kb.metric, kb.docs = manifest["metric"], tables["docs"]
        return kb

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, **options) -> KnowledgeBase:
        return cls.open(spark, path, **options) if store.Snapshots(spark, path).manifest() else cls(spark, path, **options)

    def save(self) -> int:
        if self.path is None:
            raise ValueError("no path to save to; use save_as")
        facts = {"dim": self.embedder.dim, "embedder_id": str(getattr(self.embedder, "embedder_id", "")), "metric": self.metric, "k1": bm25.K1, "b": bm25.B}
        return store.Snapshots(self.spark, self.path).save({"docs": self.docs}, **facts)

    def save_as(self, path: str) -> int:
        self.path = path
        return self.save()

    def _set(self, docs: DataFrame) -> None:
        self.docs, self._snapshot = materialise(docs.select(*self.docs.columns), "kb-docs"), None

    def __len__(self) -> int:
        return self.docs.count()

    def contains(self, url: str) -> bool:
        return not self.docs.where(F.col("url_key") == urls.url_key(url)).isEmpty()

    def _tables(self) -> dict:
        """Index tables, made on the first read after a change and used until the next."""
        if self._snapshot is None:
            self._snapshot = {
                "vecs": self.docs.select("doc_id", "embedding"),
                "post": materialise(bm25.postings(self.docs).repartition("term").sortWithinPartitions("term", "doc_id"), "kb-postings"),
                "stats": bm25.corpus_stats(self.docs),
                "edges": materialise(graph.resolve(self.docs), "kb-edges"),
            }
        return self._snapshot

    # -- changes

    def ingest(self, pages: DataFrame, pin: bool = False, now_ms: int | None = None) -> DataFrame:
        """(url, url_key, change, title, headings) for ``pages`` (PAGES, further columns ignored).

        Bodies equal to the stored ones are told apart by a join on (key, hash) before anything is
        distilled; what distils to no terms is 'skipped'; all else is embedded and upserted.
        """
        now = int(time.time() * 1000) if now_ms is None else now_ms
        rows = pages.select(urls.canonicalise_udf("url").alias("url"), urls.url_key_udf("url").alias("url_key"), F.coalesce("kind", kinds.kind_from_path(F.col("url"))).alias("kind"), "body", "etag")
        rows = rows.where("url IS NOT NULL").withColumn("content_hash", urls.content_hash_udf("body")).withColumn("ord", F.monotonically_increasing_id())
        rows = materialise(rows, "kb-pages")
        known = self.docs.select("url_key", F.col("content_hash").alias("_stored"))
        fresh = rows.join(known, "url_key", "left")
        same = fresh.where(F.col("_stored").eqNullSafe(F.col("content_hash")))
        again = rows.groupBy("url_key").count().where("count > 1").select("url_key")
        todo = fresh.where(~F.col("_stored").eqNullSafe(F.col("content_hash"))).drop("_stored")
        todo = todo.unionByName(same.drop("_stored").join(again, "url_key", "left_semi"))
        told = d.distil(todo, self.extractors)
        told = materialise(told.drop("body"), "kb-distilled")
        skipped = told.where(F.size("terms") == 0)
        kept = told.where(F.size("terms") > 0)
        vector = embed_udf(self.embedder)(F.col("embed_text"))
        kept = kept.withColumn("embedding", vector)
        if self.metric == "cosine":
            kept = kept.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
        links = d.edges_of(kept.select(F.col("url"), "links"))
        batch = kept.join(links, "url", "left").withColumns({"edges": F.coalesce("edges", F.array().cast("array<long>")), "tags": F.slice("tags", 1, 4), "fetched_at_ms": F.lit(now), "pinned": F.lit(pin)})
        batch = materialise(batch, "kb-batch")
        docs, changes = store.upsert(self.docs, batch)
        facts = told.select("ord", "title", "headings", "heading_levels")
        out = changes.join(rows.select("ord", "url"), "ord")
        out = out.unionByName(skipped.select("url_key", "ord", F.lit("skipped").alias("change"), "url"))
        out = out.unionByName(same.join(again, "url_key", "left_anti").select("url_key", "ord", F.lit("unchanged").alias("change"), "url"))
        out = materialise(out.join(facts, "ord", "left").select("url", "url_key", "change", "title", d.outline(F.col("headings"), F.col("heading_levels")).alias("headings")), "kb-outcomes")
        self._set(docs)
        return out

    def update(
        self,
        url: str,
        site: DataFrame | None = None,
        depth: int = 2,
        max_pages: int = 1000,
        scope: str | None = None,
        path_contains: list[str] | None = None,
        extensions: list[str] | None = None,
        index_path_contains: list[str] | None = None,
        pin: bool = False,
        now_ms: int | None = None,
        validators: DataFrame | None = None,
        known_edges: DataFrame | None = None,
        robots: bool = True,
        retries: int = 2,
        delay_ms: int = 0,
        concurrency: int = 8,
        user_agent: str | None = None,
        token: str | None = None,
        auth=None,
        get=fetch.http_get,
    ) -> DataFrame:
        """Crawl ``url`` and ingest what it yields; one row of counts.

        Pages come from ``site`` (url, kind, body, status, etag) if it is given, else over HTTP (``get``), level by level,
        with the delays, retries and robots rules asked for. ``validators`` (url_key, etag) and ``known_edges``
        (url_key, children) add to the stored ones, which win where both know a page.
        """
        config = crawler.CrawlConfig(depth, max_pages, scope=SCOPES.get(scope, "path"), require_path=path_contains or [], extensions=extensions or [], index_path=index_path_contains or [], concurrency=concurrency, retries=retries, min_delay_ms=delay_ms, user_agent=user_agent)
        etags, edges = self._with(self.validators(), validators), self._with(self.known_edges(), known_edges)
        signer = auth or (StaticToken.bearer(token, urls.parse(url).host) if token and urls.parse(url) else None)
        found = crawler.crawl(site, url, config, etags, edges, fetcher=lambda asked: fetch.fetch(asked, config, signer, get, robots), spark=self.spark, bodies=True)
        found = materialise(found, "kb-crawl")
        pages = found.where("yielded").orderBy("depth", "place").select("url", F.when(F.lit(site is not None), F.col("kind")).otherwise(F.coalesce("kind", kinds.kind_from_path(F.col("url")))).alias("kind"), "body", "etag")
        changes = self.ingest(pages, pin, now_ms).select("change")
        rest = found.where("outcome <> 'fetched'").select(F.when(F.col("outcome") == "revalidated", "unchanged").otherwise("failed").alias("change"))
        return store.report(changes.unionByName(rest))

    @staticmethod
    def _with(stored: DataFrame, given: DataFrame | None) -> DataFrame:
        """``stored`` rows by url_key, and of ``given`` those of other keys."""
        return stored if given is None else stored.unionByName(given.select(*stored.columns).join(stored.select("url_key"), "url_key", "left_anti"))

    def update_files(self, root: str, pin: bool = False, now_ms: int | None = None) -> DataFrame:
        pages = files.read_files(self.spark, root).withColumn("etag", F.lit(None).cast("string"))
        return store.report(self.ingest(pages, pin, now_ms).select("change"))

    def update_tree(
        self,
        spec: str,
        responses: DataFrame | None = None,
        blobs: DataFrame | None = None,
        depth: int | None = None,
        extensions: list[str] | None = None,
        max_bytes: int = 2 << 20,
        pin: bool = False,
        now_ms: int | None = None,
        token: str | None = None,
        retries: int = 2,
        concurrency: int = 8,
        get=fetch.http_get,
    ) -> DataFrame:
        """Ingest a repository: ``responses`` (json) is its tree, ``blobs`` (path, body) answers the
        fetches; entries whose hash is the stored etag are never asked for. What isn't given is
        fetched: the default branch where the spec names none, the tree, and the blobs."""
        s = tree.parse_repo_spec(spec)
        signer = StaticToken.repository(token) if token else None
        base = f"https://github.com/{s.owner}/{s.repo}/blob/{s.ref or 'HEAD'}/"
        ref = s.ref or "HEAD"
        if responses is None:
            ref, answer = tree.listing(s, lambda url: get(url, None, 64 << 20, dict(signer.credential(url).headers) if signer else {}))
            responses = self.spark.createDataFrame([(answer,)], "json string")
        entries = tree.admit(tree.entries(responses), s.subdir, depth, max_bytes, extensions)
        known = self.docs.where(F.col("url").startswith(base)).select(F.substring("url", len(base) + 1, 1 << 20).alias("path"), F.col("etag").alias("sha"))
        diff = materialise(tree.difference(entries, known), "kb-tree")
        todo = diff.where("change <> 'revalidated'")
        if blobs is None:
            raw = f"https://raw.githubusercontent.com/{s.owner}/{s.repo}/{ref}/"
            asked = todo.select("path", urls.resolve_udf(F.lit(raw), tree.quoted_path(F.col("path"))).alias("url"))
            answers = fetch.fetch(asked.withColumn("etag", F.lit(None).cast("string")), crawler.CrawlConfig(max_bytes=max_bytes, retries=retries, concurrency=concurrency), signer, get)
            blobs = materialise(asked.join(answers.where("status BETWEEN 200 AND 299").select("url", "body"), "url").select("path", "body"), "kb-blobs")
        got = todo.join(blobs.select("path", "body"), "path", "left")
        pages = got.where("body IS NOT NULL").orderBy("path").select(F.concat(F.lit(base), "path").alias("url"), kinds.kind_from_path(F.col("path")).alias("kind"), "body", F.col("sha").alias("etag"))
        changes = self.ingest(pages, pin, now_ms).select("change")
        rest = diff.where("change = 'revalidated'").select(F.lit("unchanged").alias("change")).unionByName(got.where("body IS NULL").select(F.lit("failed").alias("change")))
        return store.report(changes.unionByName(rest))

    def refresh(self, fetched: DataFrame | None = None, now_ms: int | None = None, options: refresh.RefreshOptions = refresh.RefreshOptions(), retries: int = 2, concurrency: int = 8, delay_ms: int = 0, robots: bool = False, token: str | None = None, auth=None, get=fetch.http_get) -> DataFrame:
        """Fetch the stale documents again, with their etags, and apply the answers; one row of counts.
        ``fetched`` (url_key, status, kind, body, etag) stands for the fetches if it is given."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        planned = refresh.plan(self.docs, now_ms, options)
        if fetched is None:
            asked = planned.where("action = 'fetch'").select("url_key", "url", "etag")
            config = crawler.CrawlConfig(retries=retries, concurrency=concurrency, min_delay_ms=delay_ms)
            got = fetch.fetch(asked, config, auth or (StaticToken.repository(token) if token else None), get, robots)
            kind = kinds.kind_from_content_type(F.col("content_type"))
            answers = asked.select("url_key", "url").join(got.select("url", "status", F.when(F.col("content_type").isNotNull(), kinds.refine_kind(kind, F.col("url"))).alias("kind"), "body", "etag"), "url")
            fetched = materialise(answers.drop("url"), "kb-refetched")
        answers = fetched.withColumn("content_hash", urls.content_hash_udf("body"))
        stale = planned.where("action = 'fetch'").select("url_key", "url", F.col("kind").alias("_kind"))
        bodies = answers.where("body IS NOT NULL").join(stale, "url_key").select("url", F.coalesce("kind", "_kind").alias("kind"), "body", "etag", "url_key")
        told = materialise(d.distil(bodies, self.extractors).select("url_key", F.size("terms").alias("n_terms")), "kb-refresh")
        results = answers.join(told, "url_key", "left").select("url_key", "status", "content_hash", "n_terms")
        actions = materialise(refresh.outcomes(planned, results, options), "kb-actions")
        gone = actions.where("action IN ('evict', 'gone')")
        self._set(store.touch(store.remove(self.docs, gone), actions.where("action IN ('touch', 'keep')"), now_ms))
        again = bodies.join(actions.where("action = 'reindex'").select("url_key"), "url_key", "left_semi")
        if not again.isEmpty():
            self.ingest(again.select("url", "kind", "body", "etag"), now_ms=now_ms)
        return store.report(actions.where("change IS NOT NULL").select("change"))

    def pin(self, url_prefix: str) -> int:
        return self._pin(url_prefix, True)

    def unpin(self, url_prefix: str) -> int:
        return self._pin(url_prefix, False)

    def _pin(self, prefix: str, value: bool) -> int:
        docs, changed = store.set_pinned(self.docs, prefix, value)
        n = changed.first().changed
        if n:
            index = self._snapshot
            self._set(docs)
            self._snapshot = index  # pins are no part of it
        return n

    def remove(self, url: str) -> bool:
        key = urls.url_key(url)
        if key is None or not self.contains(url):
            return False
        self._set(store.swap_remove(self.docs, key))
        return True

    # -- reads

    def validators(self) -> DataFrame:
        return self.docs.where("etag IS NOT NULL").select("url_key", "etag")

    def known_edges(self) -> DataFrame:
        """(url_key, children): the stored documents that each one links to."""
        e = graph.resolve(self.docs)
        child = self.docs.select(F.col("doc_id").alias("dst"), F.col("url").alias("child"))
        source = self.docs.select(F.col("doc_id").alias("src"), "url_key")
        return e.join(child, "dst").join(source, "src").groupBy("url_key").agg(F.array_sort(F.collect_set("child")).alias("children"))

    def search(self, query: str, k: int = 10, path_prefix: str | None = None, tag: str | None = None, graph_boost: float = 0.0, where: filters.Filter | None = None, params: RankParams | None = None) -> DataFrame:
        """Ranked hits: rank, url, score, title, snippet, kind, tags."""
        return self.search_many(self.spark.createDataFrame([(0, query)], "query_id long, text string"), k, path_prefix, tag, graph_boost, where, params).drop("query_id").orderBy("rank")

    def search_many(self, queries: DataFrame, k: int = 10, path_prefix: str | None = None, tag: str | None = None, graph_boost: float = 0.0, where: filters.Filter | None = None, params: RankParams | None = None) -> DataFrame:
        """Hits for each of ``queries`` (query_id, text) in one job."""
        from hybridkb.functions.text import normalized_tokens

        asked = queries.select("query_id", embed_udf(self.embedder)(F.col("text")).alias("vector"), normalized_tokens(F.col("text")).alias("terms"))
        return self.search_prepared(asked, k, path_prefix, tag, graph_boost, where, params)

    def search_prepared(self, queries: DataFrame, k: int = 10, path_prefix: str | None = None, tag: str | None = None, graph_boost: float = 0.0, where: filters.Filter | None = None, params: RankParams | None = None) -> DataFrame:
        """Hits for ``queries`` (query_id, vector, terms); vectors of another length are an error."""
        if not queries.where(F.size("vector") != self.embedder.dim).isEmpty():
            raise DimensionMismatch(f"query vectors must have {self.embedder.dim} components")
        used = [where] if where else []
        used += [filters.path_prefix(path_prefix)] if path_prefix else []
        used += [filters.tag(tag)] if tag else []
        p = params or RankParams(graph_boost=graph_boost)
        t = self._tables()
        ranked = search.hybrid(self.docs, t["vecs"], t["post"], t["stats"], queries, k, filters.all_of(used), p, t["edges"], self.metric)
        return search.hits(ranked, self.docs)

    def related(self, url: str, k: int = 10) -> DataFrame:
        """Pages that ``url`` links to and pages linked beside it; an unknown URL gives none, no URL an error."""
        key = urls.url_key(url)
        if key is None:
            raise ValueError(f"not a URL: {url}")
        seeds = self.docs.where(F.col("url_key") == key).select("doc_id")
        ranked = graph.related(self._tables()["edges"], seeds, k).withColumn("query_id", F.lit(0)).drop("seed")
        return search.hits(ranked, self.docs).drop("query_id").orderBy("rank")

    def export(self) -> DataFrame:
        return store.export(self.docs, self._tables()["edges"])
