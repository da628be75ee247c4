"""Upsert, removal, pins, refresh, export and crawls over ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hybridkb.operators import refresh, store
from hybridkb.plans.catalog import register
from hybridkb.plans.common import DAY_MS, EDGES_SQL, KB_SQL, NOW_MS, kb_docs, link_edges
from hybridkb.session import table
from hybridkb.sources import crawl, fetch

TTL, OLD = 2 * DAY_MS, 3 * DAY_MS


def _stored(spark, sf_dir):
    """The labelled documents, keyed by doc_id."""
    marked = table(spark, sf_dir, "labels").select("doc_id").where("doc_id IS NOT NULL").distinct()
    return kb_docs(spark, sf_dir).join(marked, "doc_id", "left_semi").withColumn("url_key", F.col("doc_id")).drop("text")


def _batch(spark, sf_dir):
    """All documents, changed where French, and the Spanish ones a second time as they were."""
    docs = kb_docs(spark, sf_dir).drop("text")
    first = docs.withColumns({"content_hash": F.when(F.col("lang") == "fr", F.col("content_hash") + 1).otherwise(F.col("content_hash")), "ord": F.col("doc_id"), "pinned": F.lit(False)})
    again = docs.where("lang = 'es'").withColumns({"ord": F.col("doc_id") + 1_000_000_000, "pinned": F.lit(True)})
    return first.unionByName(again).withColumn("url_key", F.col("doc_id")).drop("doc_id")


_STORED_SQL = f"{KB_SQL}, stored AS (SELECT * FROM kb WHERE doc_id IN (SELECT doc_id FROM labels))"
_BATCH_SQL = "batch AS (SELECT doc_id AS url_key, content_hash + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS h, doc_id AS ord, url FROM kb UNION ALL SELECT doc_id, content_hash, doc_id + 1000000000, url FROM kb WHERE lang = 'es')"
_CHANGE_SQL = "changes AS (SELECT b.url_key, ord, h, CASE WHEN prev IS NULL THEN 'added' WHEN prev = h THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT b.*, coalesce(lag(h) OVER (PARTITION BY b.url_key ORDER BY ord), s.content_hash) AS prev FROM batch b LEFT JOIN stored s ON s.doc_id = b.url_key) b)"


@register("upsert_outcomes", f"WITH {_STORED_SQL}, {_BATCH_SQL}, {_CHANGE_SQL} SELECT url_key, ord, change FROM changes")
def upsert_outcomes(spark, sf_dir):
    return store.upsert(_stored(spark, sf_dir), _batch(spark, sf_dir))[1]


@register(
    "upsert_documents",
    f"""WITH {_STORED_SQL}, {_BATCH_SQL}, {_CHANGE_SQL}, applied AS (SELECT url_key, min(ord) AS ord, arg_max(h, ord) AS h FROM changes WHERE change <> 'unchanged' GROUP BY url_key),
top AS (SELECT coalesce(max(doc_id) + 1, 0) AS start FROM stored)
SELECT s.doc_id, s.doc_id AS url_key, coalesce(a.h, s.content_hash) AS content_hash, s.pinned FROM stored s LEFT JOIN applied a ON a.url_key = s.doc_id
UNION ALL SELECT start + row_number() OVER (ORDER BY a.ord) - 1, url_key, h, false FROM applied a, top WHERE url_key NOT IN (SELECT doc_id FROM stored)""",
)
def upsert_documents(spark, sf_dir):
    docs, _ = store.upsert(_stored(spark, sf_dir), _batch(spark, sf_dir))
    return docs.select("doc_id", "url_key", "content_hash", "pinned")


@register(
    "update_report",
    f"WITH {_STORED_SQL}, {_BATCH_SQL}, {_CHANGE_SQL} SELECT count_if(change = 'added')::BIGINT AS added, count_if(change = 'updated')::BIGINT AS updated, count_if(change = 'unchanged')::BIGINT AS unchanged, count(*) AS pages_seen FROM changes",
)
def update_report(spark, sf_dir):
    return store.report(store.upsert(_stored(spark, sf_dir), _batch(spark, sf_dir))[1]).select("added", "updated", "unchanged", "pages_seen")


@register("url_dedup_upsert", "SELECT canonical AS url, max(page_id) AS page_id, count(*) AS spellings FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS canonical FROM pages UNION ALL SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') FROM pages) GROUP BY canonical")
def url_dedup_upsert(spark, sf_dir):
    """Pages and odd spellings of their URLs (upper case, a fragment, a slash), one row for each document."""
    from hybridkb.functions import urls

    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "").alias("url"))
    odd = pages.select("page_id", F.concat(F.upper(F.regexp_extract("url", "^[^:]+://[^/]*", 0)), F.regexp_extract("url", "^[^:]+://[^/]*(.*)$", 1), F.lit("/#again")).alias("url"))
    rows = pages.unionByName(odd).select("page_id", urls.canonicalise_udf("url").alias("url"), urls.url_key_udf("url").alias("url_key"))
    batch = rows.select("url", "url_key", F.col("page_id").alias("content_hash"), F.col("page_id").alias("ord"), F.lit(False).alias("pinned"), "page_id")
    batch = batch.withColumn("ord", F.col("ord") * 2 + F.row_number().over(Window.partitionBy("url_key", "page_id").orderBy("url")) - 1)
    stored = spark.createDataFrame([], "doc_id long, url_key long, url string, content_hash long, pinned boolean, page_id long")
    docs, outcomes = store.upsert(stored, batch)
    return docs.join(outcomes.groupBy("url_key").agg(F.count(F.lit(1)).alias("spellings")), "url_key").select("url", "page_id", "spellings")


_TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"


def _toxic_keys(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("url_key"))


def _all(spark, sf_dir):
    return kb_docs(spark, sf_dir).withColumn("url_key", F.col("doc_id"))


@register("remove_docs", f"WITH {KB_SQL} SELECT doc_id, url FROM kb WHERE doc_id NOT IN {_TOXIC}")
def remove_docs(spark, sf_dir):
    return store.remove(_all(spark, sf_dir), _toxic_keys(spark, sf_dir)).select("doc_id", "url")


@register("swap_remove", "WITH m AS (SELECT max(doc_id) AS last FROM documents) SELECT CASE WHEN doc_id = last THEN 7 ELSE doc_id END AS doc_id, doc_id AS url_key FROM documents, m WHERE doc_id <> 7")
def swap_remove(spark, sf_dir):
    return store.swap_remove(_all(spark, sf_dir), 7).select("doc_id", "url_key")


@register("touch", f"WITH {KB_SQL} SELECT doc_id, CASE WHEN doc_id IN {_TOXIC} THEN {NOW_MS} ELSE fetched_at_ms END::BIGINT AS fetched_at_ms FROM kb")
def touch(spark, sf_dir):
    return store.touch(_all(spark, sf_dir), _toxic_keys(spark, sf_dir), NOW_MS).select("doc_id", "fetched_at_ms")


@register("pin_prefix", f"WITH {KB_SQL} SELECT doc_id, pinned OR starts_with(url, 'https://src1.example.com/en') AS pinned FROM kb")
def pin_prefix(spark, sf_dir):
    return store.set_pinned(_all(spark, sf_dir), "https://src1.example.com/en")[0].select("doc_id", "pinned")


@register("pin_changed", f"WITH {KB_SQL} SELECT count(*) AS changed FROM kb WHERE pinned AND starts_with(url, 'https://src1')")
def pin_changed(spark, sf_dir):
    return store.set_pinned(_all(spark, sf_dir), "https://src1", False)[1]


_AGE = f"greatest({NOW_MS} - fetched_at_ms, 0)"
_PLAN = f"CASE WHEN {_AGE} > {OLD} AND NOT pinned THEN 'evict' WHEN {_AGE} >= {TTL} THEN 'fetch' ELSE 'fresh' END"
_OPTIONS = refresh.RefreshOptions(TTL, OLD)


@register("refresh_plan", f"WITH {KB_SQL} SELECT doc_id, {_PLAN} AS action FROM kb")
def refresh_plan(spark, sf_dir):
    return refresh.plan(_all(spark, sf_dir), NOW_MS, _OPTIONS).select("doc_id", "action")


_RESULT_SQL = "CASE doc_id % 6 WHEN 0 THEN 304 WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 404 WHEN 4 THEN 503 ELSE 200 END AS status, CASE WHEN doc_id % 6 = 2 THEN content_hash ELSE content_hash + 1 END AS new_hash, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE 9 END AS n_terms"
_ACTION = "CASE WHEN plan IN ('evict', 'fresh') THEN plan WHEN status = 304 OR status = 200 AND new_hash = content_hash THEN 'touch' WHEN status = 200 AND n_terms = 0 THEN 'keep' WHEN status = 200 THEN 'reindex' WHEN status = 404 AND NOT pinned THEN 'gone' WHEN status = 404 THEN 'gone_kept' ELSE 'retry' END"
_TOLD = "CASE action WHEN 'evict' THEN 'removed' WHEN 'gone' THEN 'removed' WHEN 'touch' THEN 'unchanged' WHEN 'keep' THEN 'unchanged' WHEN 'reindex' THEN 'refreshed' WHEN 'gone_kept' THEN 'failed' WHEN 'retry' THEN 'failed' END"
_OUT_SQL = f"WITH {KB_SQL}, out AS (SELECT doc_id AS url_key, {_ACTION} AS action, {_TOLD} AS change FROM (SELECT *, {_PLAN} AS plan, {_RESULT_SQL} FROM kb))"


def _refreshed(spark, sf_dir):
    docs = _all(spark, sf_dir)
    kind = F.col("doc_id") % 6
    status = F.element_at(F.array(*map(F.lit, [304, 200, 200, 404, 503, 200])), (kind + 1).cast("int"))
    fetched = docs.select("url_key", status.alias("status"), F.when(kind == 2, F.col("content_hash")).otherwise(F.col("content_hash") + 1).alias("content_hash"), F.when(kind == 5, 0).otherwise(9).alias("n_terms"))
    return refresh.outcomes(refresh.plan(docs, NOW_MS, _OPTIONS), fetched, _OPTIONS)


@register("refresh_outcomes", f"{_OUT_SQL} SELECT url_key, action, change FROM out")
def refresh_outcomes(spark, sf_dir):
    return _refreshed(spark, sf_dir)


@register("refresh_report", f"{_OUT_SQL} SELECT count_if(change = 'refreshed')::BIGINT AS refreshed, count_if(change = 'unchanged')::BIGINT AS unchanged, count_if(change = 'removed')::BIGINT AS removed, count_if(change = 'failed')::BIGINT AS failed, count(change) AS total FROM out")
def refresh_report(spark, sf_dir):
    return store.report(_refreshed(spark, sf_dir)).select("refreshed", "unchanged", "removed", "failed", "total")


@register("export_docs", f"WITH {KB_SQL}, {EDGES_SQL} SELECT doc_id, url, kind, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS links FROM kb LEFT JOIN edges ON src = doc_id GROUP BY ALL")
def export_docs(spark, sf_dir):
    out = store.export(kb_docs(spark, sf_dir), link_edges(spark, sf_dir))
    return out.select("doc_id", "url", "kind", F.array_join(F.transform("links", lambda x: x.cast("string")), " ").alias("links"))


@register("edge_cap_64", "SELECT l_suppkey, count(*) AS edges FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey * 10 + l_linenumber), l_partkey) AS r FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE r <= 64 GROUP BY l_suppkey")
def edge_cap_64(spark, sf_dir):
    """Distinct targets in order of first appearance, the first 64 of each source."""
    from hybridkb.functions import distil

    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).alias("x"))
    pages = lines.select("l_suppkey", F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/")).alias("url"), F.transform("x", lambda r: F.concat(F.lit("/part/"), r["l_partkey"].cast("string"))).alias("links"))
    return pages.join(distil.edges_of(pages), "url").select("l_suppkey", F.size("edges").cast("long").alias("edges"))


def site(spark, sf_dir):
    """The documents as a site: page /d/<id> links to the pages of its edges."""
    e = link_edges(spark, sf_dir).groupBy(F.col("src").alias("doc_id")).agg(F.array_sort(F.collect_list("dst")).alias("to"))
    links = F.array_join(F.transform("to", lambda d: F.concat(F.lit('<a href="/d/'), d.cast("string"), F.lit('">next</a>'))), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left")
    body = F.encode(F.concat(F.lit("<html><body>"), F.coalesce(links, F.lit("")), F.lit("</body></html>")), "UTF-8")
    return rows.select(F.concat(F.lit("https://site.example.com/d/"), F.col("doc_id").cast("string")).alias("url"), F.lit("html").alias("kind"), body.alias("body"), F.lit(200).alias("status"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("etag"))


_REACH = "RECURSIVE n AS (SELECT count(*) AS n FROM documents), edges AS (SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, unnest([(doc_id * 7 + 1) % n, (doc_id * 3 + 2) % n, doc_id // 2]) AS dst FROM documents, n) WHERE src <> dst), walk AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < {depth})"


@register("crawl_bfs", f"WITH {_REACH.format(depth=40)} SELECT 'https://site.example.com/d/' || id AS url, min(depth) AS depth, 'fetched' AS outcome FROM walk GROUP BY id")
def crawl_bfs(spark, sf_dir):
    """Until no page is left: every document that links lead to."""
    return crawl.crawl(site(spark, sf_dir), "https://site.example.com/d/0", crawl.CrawlConfig(40, 1_000_000_000, scope="host")).select("url", "depth", "outcome")


@register("crawl_conditional", f"WITH {_REACH.format(depth=6)} SELECT 'https://site.example.com/d/' || id AS url, min(depth) AS depth, CASE WHEN id % 2 = 0 THEN 'revalidated' ELSE 'fetched' END AS outcome FROM walk GROUP BY id")
def crawl_conditional(spark, sf_dir):
    """Pages of even number are known with their etag and links; they are revalidated and followed all the same."""
    from hybridkb.functions import urls

    s = site(spark, sf_dir).withColumn("url_key", urls.url_key_udf("url"))
    number = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    known = s.select("url_key", F.when(number % 2 == 0, F.col("etag")).otherwise(F.lit("old")).alias("etag"))
    children = F.transform(F.expr("regexp_extract_all(decode(body, 'UTF-8'), 'href=\"([^\"]+)\"', 1)"), lambda h: F.concat(F.lit("https://site.example.com"), h))
    edges = s.select("url_key", children.alias("children"))
    return crawl.crawl(s.drop("url_key"), "https://site.example.com/d/0", crawl.CrawlConfig(6, 1_000_000_000, scope="host"), known, edges).select("url", "depth", "outcome")


@register("crawl_fetch", f"WITH {_REACH.format(depth=6)} SELECT 'https://site.example.com/d/' || id AS url, min(depth) AS depth, CASE WHEN id % 5 = 3 THEN 'failed' ELSE 'fetched' END AS outcome FROM (SELECT * FROM walk) GROUP BY id".replace("FROM walk JOIN edges ON src = id WHERE", "FROM walk JOIN edges ON src = id WHERE id % 5 <> 3 AND"))
def crawl_fetch(spark, sf_dir):
    """The same pages asked for one by one of a stand-in for the network; those of numbers 3, 8, 13, … aren't there."""
    n = table(spark, sf_dir, "documents").count()

    def get(url, etag, most, headers):
        if url.endswith("/robots.txt"):
            return {"status": 200, "body": b"User-agent: *\nAllow: /\n"}
        i = int(url.rsplit("/", 1)[1])
        if i % 5 == 3:
            return {"status": 404, "error": "status 404"}
        links = "".join(f'<a href="/d/{j}">next</a>' for j in sorted({(7 * i + 1) % n, (3 * i + 2) % n, i // 2} - {i}))
        return {"status": 200, "body": f"<html><body>{links}</body></html>".encode(), "content_type": "text/html"}

    config = crawl.CrawlConfig(6, 1_000_000_000, scope="host")
    found = crawl.crawl(None, "https://site.example.com/d/0", config, fetcher=lambda asked: fetch.fetch(asked, config, get=get, robots=True), spark=spark)
    return found.select("url", "depth", "outcome")
