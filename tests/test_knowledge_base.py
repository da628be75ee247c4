"""The handle end to end over small sites, trees and files."""

import json

import pytest
from pyspark.sql import functions as F

from hybridkb.functions import urls
from hybridkb.knowledge_base import DimensionMismatch, KnowledgeBase
from hybridkb.operators import filters, refresh, store
from hybridkb.sources import auth, crawl, fetch, tree
from hybridkb.streaming.ingest import ingest_stream, page_stream

ROOT = "https://docs.example.com/docs/"
PAGES = {
    "index": ("<title>Docs home</title><p>Start here about clusters</p><a href='/docs/net'>n</a> <a href='/docs/store#x'>s</a> <a href='https://else.example.org/'>e</a><a href='/logo.png'>l</a>", 200),
    "net": ("<h1>Private networking</h1><p>Private service connect for networking and subnets</p><a href='/docs/store'>s</a>", 200),
    "store": ("<title>Storage</title><p>Buckets keep objects; storage classes differ</p><a href='/docs/gone'>g</a>", 200),
    "gone": ("", 404),
}


def site(spark, changed=None):
    rows = []
    for name, (body, status) in PAGES.items():
        body = (changed or {}).get(name, body)
        rows.append((ROOT if name == "index" else ROOT + name, "html", bytearray(body.encode()), status, f"{name}-{len(body)}"))
    return spark.createDataFrame(rows, "url string, kind string, body binary, status int, etag string")


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    base = KnowledgeBase(spark, str(tmp_path_factory.mktemp("kb")))
    r = base.update(ROOT, site(spark), depth=3, scope="host", now_ms=1000).first()
    assert (r.added, r.failed, r.pages_seen) == (3, 1, 3)
    return base


def test_search_and_related(kb):
    assert kb.search("private service connect", 2).first().url == ROOT + "net"
    assert kb.search("storage buckets", 2).first().title == "Storage"
    assert kb.search("storage", 5, path_prefix="/docs/net").count() == 1
    assert {r.url for r in kb.search("anything", 5, where=~filters.kind("html")).collect()} == set()
    assert [r.url for r in kb.related(ROOT, 5).collect()] == [ROOT + "net", ROOT + "store"]
    assert kb.related("https://docs.example.com/unknown").count() == 0
    with pytest.raises(ValueError, match="not a URL"):
        kb.related("nothing")


def test_crawl_again_changes_nothing(spark, kb):
    r = kb.update(ROOT, site(spark), depth=3, scope="host", now_ms=2000).first()
    assert (r.added, r.updated, r.unchanged) == (0, 0, 3) and len(kb) == 3


def test_save_and_open(spark, kb):
    kb.save()
    again = KnowledgeBase.open(spark, kb.path)
    for q in ("private networking", "storage"):
        assert kb.search(q, 3).collect() == again.search(q, 3).collect()
    with pytest.raises(DimensionMismatch):
        from hybridkb.functions.embed import HashEmbedder

        KnowledgeBase.open(spark, kb.path, embedder=HashEmbedder(16))


def test_update_pin_refresh_remove(spark, kb):
    r = kb.update(ROOT, site(spark, {"store": "<title>Storage two</title><p>Archive tiers</p>"}), depth=1, scope="host", now_ms=3000).first()
    assert (r.updated, r.unchanged) == (1, 2)
    assert kb.search("archive tiers", 1).first().title == "Storage two"
    assert kb.pin(ROOT + "net") == 1 and kb.pin(ROOT + "net") == 0
    k = {n: urls.url_key(ROOT + (n if n != "index" else "")) for n in PAGES}
    answers = [(k["index"], 304, None), (k["net"], 404, None), (k["store"], 200, bytearray(b"<p>Cold archive only</p>"))]
    fetched = spark.createDataFrame([(a, s, "html", b, "e") for a, s, b in answers], "url_key long, status int, kind string, body binary, etag string")
    r = kb.refresh(fetched, 10_000, refresh.RefreshOptions(ttl_ms=100)).first()
    assert (r.refreshed, r.unchanged, r.removed, r.failed, r.total) == (1, 1, 0, 1, 3)
    assert kb.unpin(ROOT) == 1
    r = kb.refresh(fetched.where("status = 404"), 20_000, refresh.RefreshOptions(ttl_ms=15_000)).first()
    assert r.removed == 1 and len(kb) == 2
    assert kb.remove(ROOT) and not kb.remove(ROOT) and len(kb) == 1


def test_tree_and_files(spark, tmp_path):
    kb = KnowledgeBase.in_memory(spark)
    entry = lambda p, s, **k: {"path": p, "type": "blob", "sha": s, "size": 10, **k}
    response = {"tree": [entry("a/x.md", "1"), entry("a/b/y.md", "2"), entry("ax/z.md", "3"), entry("a/p.png", "4"), entry("a/big.md", "5", size=1 << 30), {"path": "a/b", "type": "tree", "sha": "6"}], "truncated": False}
    responses = spark.createDataFrame([(json.dumps(response),)], "json string")
    blobs = spark.createDataFrame([("a/x.md", bytearray(b"# Alpha\nalpha words")), ("a/b/y.md", bytearray(b"# Beta\nbeta words"))], "path string, body binary")
    assert kb.update_tree("github:own/repo@main//a", responses, blobs).first().added == 2
    assert kb.update_tree("https://github.com/own/repo/tree/main/a", responses, blobs).first().unchanged == 2
    with pytest.raises(Exception, match="truncated"):
        tree.entries(spark.createDataFrame([('{"tree": [], "truncated": true}',)], "json string")).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "n.txt").write_text("Plain title\nplain words")
    (tmp_path / "d" / "i.png").write_bytes(b"x")
    assert kb.update_files(str(tmp_path)).first().added == 1


def test_specs():
    assert tree.parse_repo_spec("https://github.com/o/r.git") == ("o", "r", "", "")
    for bad in ("github:o", "github:o/r@", "github:o/r/x", "https://github.com/o", "https://github.com/o/r/issues/1", "https://github.com/o/r/tree", "ftp://x"):
        with pytest.raises(ValueError):
            tree.parse_repo_spec(bad)


def test_stream(spark, tmp_path):
    drop = tmp_path / "drop"
    rows = [("https://e.example/a", "text", bytearray(b"first page about apples"), None), ("https://e.example/b", "text", bytearray(b"second page about pears"), None)]
    spark.createDataFrame(rows, "url string, kind string, body binary, etag string").write.parquet(str(drop))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    ingest_stream(page_stream(spark, str(drop)), kb, str(tmp_path / "check")).awaitTermination()
    assert len(KnowledgeBase.open(spark, kb.path)) == 2


def test_crawl_limits(spark):
    s = site(spark)
    urls_of = lambda c: [r.url for r in crawl.crawl(s, ROOT, c).where("yielded").orderBy("depth", "place").collect()]
    assert urls_of(crawl.CrawlConfig(0, scope="host")) == [ROOT]
    assert urls_of(crawl.CrawlConfig(2, 2, scope="host")) == [ROOT, ROOT + "net"]
    assert urls_of(crawl.CrawlConfig(2, scope="host", index_path=["store"])) == [ROOT + "store"]
    with pytest.raises(RuntimeError):
        crawl.crawl(s, ROOT + "gone")


def test_fetch_retries_and_auth(spark):
    def get(url, etag, most, headers):
        if url.endswith("busy"):
            return {"status": 503, "error": "status 503", "headers": {}}
        if url.endswith("who"):
            return {"status": 200, "body": headers.get("Authorization", "-").encode()}
        return {"status": 304 if etag else 404, "error": None if etag else "status 404"}

    asked = spark.createDataFrame([("http://h.example/busy", None), ("http://h.example/who", None), ("http://h.example/x", "e"), ("http://h.example/y", None), ("ftp://z/", None)], "url string, etag string")
    got = {r.url.rpartition("/")[2] or "ftp": r for r in fetch.fetch(asked, auth=auth.StaticToken.bearer("t", "example"), get=get, sleep=lambda s: None).collect()}
    assert got["busy"].attempts == 3 and got["x"].status == 304 and got["y"].attempts == 1 and got["ftp"].error
    assert bytes(got["who"].body) == b"Bearer t"
    assert auth.StaticToken.repository("t").credential("https://x.api.github.com/").headers == {}
    assert "secret" not in repr(auth.StaticToken.bearer("secret"))


def test_waits():
    assert crawl.backoff_ms(2) == 1000 and crawl.backoff_ms(0, 90_000) == 30_000
    assert fetch.imf_date_ms("Sun, 06 Nov 1994 08:49:37 GMT") == 784111777000
    assert fetch.imf_date_ms("06 Nov 1994 08:49:37") is None
    assert fetch.retry_after_ms({"Retry-After": "7"}, 0) == 7000 and fetch.retry_after_ms({}, 0) == 1000
    assert fetch.retry_after_ms({"x-ratelimit-reset": "999999"}, 0) == 300_000
    p = fetch.Pacer(lambda: 5.0)
    assert (p.reserve("a", 2), p.reserve("a", 2), p.reserve("b", 2)) == (0, 2, 0)
    robots = fetch.Robots(lambda u: b"User-agent: *\nDisallow: /no\nCrawl-delay: 2\n")
    assert not robots.allowed("http://h/no/x") and robots.allowed("http://h/yes") and robots.delay_ms("http://h/") == 2000


def test_refreshing_token():
    now, made = [0.0], []
    t = auth.RefreshingToken(lambda: (made.append(1) or f"t{len(made)}", now[0] + 100), clock=lambda: now[0])
    assert t.credential("http://x/").headers == t.credential("http://x/").headers and len(made) == 1
    now[0] = 50
    t.credential("http://x/")
    assert len(made) == 2


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_large_upsert_keeps_every_row(spark, adaptive):
    """60,000 rows of 1 KB over several partitions: equal counts, dense numbers in order of ``ord``."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        stored = spark.createDataFrame([], "doc_id long, url_key long, content_hash long, pinned boolean, body string")
        batch = spark.range(60_000).select(F.xxhash64("id").alias("url_key"), F.col("id").alias("content_hash"), F.col("id").alias("ord"), F.lit(False).alias("pinned"), F.repeat(F.lit("x"), 1000).alias("body")).repartition(8)
        docs, outcomes = store.upsert(stored, batch)
        seen = docs.join(batch.select("url_key", "ord"), "url_key")
        assert docs.count() == outcomes.count() == seen.where("doc_id = ord").count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_large_ingest_keeps_every_page(spark):
    pages = spark.range(8_000).select(F.concat(F.lit("https://h.example.com/p/"), F.col("id").cast("string")).alias("url"), F.lit("text").alias("kind"), F.encode(F.concat(F.lit("page "), F.col("id").cast("string"), F.repeat(F.lit(" word"), 200)), "UTF-8").alias("body"), F.lit(None).cast("string").alias("etag")).repartition(8)
    kb = KnowledgeBase.in_memory(spark)
    assert kb.ingest(pages).where("change = 'added'").count() == 8_000
    assert len(kb) == 8_000 and kb.docs.agg(F.countDistinct("doc_id"), F.max("doc_id")).first()[:] == (8_000, 7_999)


def web(seen=None, pages=None):
    """A stand-in for the network, in place of ``fetch.http_get``; ``seen`` is a folder where requests are noted."""
    import uuid
    from pathlib import Path

    def get(url, etag, most, headers):
        if seen:
            (Path(seen) / uuid.uuid4().hex).write_text(f"{url}|{etag or ''}|{headers.get('Authorization', '')}")
        if url.endswith("/robots.txt"):
            return {"status": 200, "body": b"User-agent: *\nDisallow: /docs/private\n"}
        name = url[len(ROOT) :] or "index"
        body, status = (pages or PAGES).get(name, ("", 404))
        if status == 200 and etag == f"{name}-{len(body)}":
            return {"status": 304}
        return {"status": status, "body": body.encode(), "etag": f"{name}-{len(body)}", "content_type": "text/html; charset=utf-8", "error": None if status == 200 else f"status {status}"}

    return get


def requests_of(folder):
    got = [p.read_text().split("|") for p in folder.iterdir()]
    for p in folder.iterdir():
        p.unlink()
    return {u[len(ROOT) :] or "index": (etag, signed) for u, etag, signed in got if not u.endswith("robots.txt")}


def test_live_crawl_and_refresh(spark, tmp_path):
    from hybridkb.functions.urls import url_key

    kb = KnowledgeBase.in_memory(spark)
    pages = PAGES | {"index": (PAGES["index"][0] + "<a href='/docs/private'>p</a>", 200), "private": ("<p>not for robots</p>", 200)}
    r = kb.update(ROOT, depth=3, scope="host", now_ms=1000, token="t", get=web(str(tmp_path), pages)).first()
    assert (r.added, r.failed) == (3, 2) and kb.search("storage buckets", 1).first().title == "Storage"
    seen = requests_of(tmp_path)
    assert set(seen) == {"index", "net", "store", "gone"} and seen["net"] == ("", "Bearer t"), "robots.txt keeps the crawl from the rest"

    r = kb.update(ROOT, depth=3, scope="host", now_ms=2000, get=web(str(tmp_path), pages)).first()
    again = requests_of(tmp_path)
    assert (r.added, r.updated, r.unchanged) == (0, 0, 3) and all(again[n][0] for n in ("index", "net", "store")), "etags go along"

    changed = pages | {"store": ("<title>Storage two</title><p>Archive tiers</p>", 200), "net": ("", 404)}
    r = kb.refresh(now_ms=10_000, options=refresh.RefreshOptions(ttl_ms=100), get=web(pages=changed)).first()
    assert (r.refreshed, r.unchanged, r.removed, r.failed) == (1, 1, 1, 0) and len(kb) == 2
    assert kb.search("archive tiers", 1).first().title == "Storage two"

    fresh = KnowledgeBase.in_memory(spark)  # what the caller knows of pages that the index lacks
    known = spark.createDataFrame([(url_key(ROOT), f"index-{len(PAGES['index'][0])}")], "url_key long, etag string")
    edges = spark.createDataFrame([(url_key(ROOT), [ROOT + "net"])], "url_key long, children array<string>")
    r = fresh.update(ROOT, depth=1, scope="host", validators=known, known_edges=edges, get=web()).first()
    assert (r.added, r.unchanged) == (1, 1)


def test_live_tree(spark):
    listing = {"tree": [{"path": p, "type": "blob", "sha": s, "size": 9} for p, s in (("a/x y.md", "1"), ("b.md", "2"), ("c.md", "3"))], "truncated": False}

    def get(url, etag, most, headers):
        if url == "https://api.github.com/repos/own/repo":
            return {"status": 200, "body": b'{"default_branch": "trunk"}'}
        if url == "https://api.github.com/repos/own/repo/git/trees/trunk?recursive=1":
            return {"status": 200, "body": json.dumps(listing).encode()}
        if url.startswith("https://raw.githubusercontent.com/own/repo/trunk/") and headers.get("Authorization") == "Bearer t":
            return {"status": 404, "error": "status 404"} if url.endswith("c.md") else {"status": 200, "body": f"# Title\nwords of {url}".encode()}
        return {"status": 500, "error": "unexpected"}

    kb = KnowledgeBase.in_memory(spark)
    r = kb.update_tree("github:own/repo", token="t", retries=0, get=get).first()
    assert (r.added, r.failed) == (2, 1)
    r = kb.update_tree("github:own/repo", token="t", retries=0, get=get).first()
    assert (r.added, r.unchanged, r.failed) == (0, 2, 1)
    with pytest.raises(RuntimeError):
        kb.update_tree("github:own/other", get=get)


def test_a_further_extractor(spark):
    from hybridkb.functions import distil

    class Csv(distil.Extractor):
        kinds = frozenset(["text"])

        def extract(self, df):
            line = F.split(F.decode("body", "UTF-8"), "\n")
            none = F.array().cast("array<string>")
            return df.withColumn("facts", F.struct(F.get(line, F.lit(0)).alias("title"), F.lit("xx").alias("lang"), none.alias("headings"), F.array().cast("array<int>").alias("levels"), F.array_join(F.slice(line, 2, 1000), " ").alias("body"), none.alias("links")))

    kb = KnowledgeBase.in_memory(spark, extractors=(Csv(),))
    rows = [("https://e.example/a.txt", "text", bytearray(b"name,size\napples,3\npears,4"), None), ("https://e.example/b.md", "markdown", bytearray(b"# Other\nplums"), None)]
    kb.ingest(spark.createDataFrame(rows, "url string, kind string, body binary, etag string"))
    assert {r.title: r.lang for r in kb.docs.collect()} == {"name,size": "xx", "Other": None}


def test_presigned():
    signed = auth.Presigned(auth.StaticToken.bearer("t"), lambda u: "Signature=" in u)
    assert signed.credential("http://h/x?Signature=1").headers == {} and signed.credential("http://h/x").headers
