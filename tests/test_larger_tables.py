"""Findings on larger tables: results against SQL where the small test tables show no fault, and what bounds time, disk and memory."""

import os
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridkb.functions import distil, html, text, udf, urls
from hybridkb.operators import bm25
from hybridkb.plans import catalog
from hybridkb.sources import crawl

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def against_sql(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = [tuple(r[n] for n in names) for r in catalog.queries()[name](spark, str(sf_dir)).collect()]
    assert sorted(rows, key=str) == sorted(found.fetchall(), key=str)


def test_titles_cut_within_references(spark, tmp_path):
    titles = ["of.&&&amp", "a &quot;b&quot; &amp;lt; &lt;", "plain", "&am", "x&gt;y&g"]
    rows = [(i, f"https://h/{i}", f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    against_sql(spark, tmp_path, "html_title_lang", ["pages"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["rrf_fusion", "rrf_weighted", "hybrid_filtered", "hybrid_graph_boost", "bm25_filtered", "bm25_batch"])
def test_texts_are_read_once_and_never_shuffled(spark, name):
    """What is left after the terms' hits were written reads no text, and scores of a batch aren't grouped by pairs."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ReadSchema: struct<[^>]*\btext:", plan)
    assert name != "bm25_batch" or not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)


def test_batch_of_queries_by_blocks(spark, monkeypatch):
    """The product gives what the joins of ``score`` give: over several blocks, with ties, empty and null documents."""
    monkeypatch.setattr(bm25, "DOCS", 7)
    monkeypatch.setattr(bm25, "QUERIES", 3)
    docs = [(i, [f"t{i % 4}", f"t{i % 3}", f"t{i % 3}", "all"]) for i in range(90)] + [(200, []), (201, None), (None, ["t1"])]
    docs = spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(3)
    asked = spark.createDataFrame([(q, t) for q in range(10) for t in (f"t{q % 4}", f"t{q % 5}", "all" if q % 2 else "none")] + [(50, "none"), (51, None)], "query_id long, term string")
    hits = bm25.Hits(docs, asked)
    old = bm25.score(bm25.postings(docs), bm25.corpus_stats(docs), asked)
    assert hits.stats().collect() == bm25.corpus_stats(docs).collect()
    for scores in (old, bm25.score(hits.postings(), hits.stats(), asked)):
        want = bm25.top_k(scores.withColumn("score", F.round("score", 6)), 5)
        assert sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, hits.top_k(5, digits=6).collect()))
    assert hits.top_k(5, digits=6).count() == 50


def test_edges_are_read_as_far_as_the_cap(spark):
    """Same edges as from all links, of repeated and odd rows too; links beyond the cap stay within their row."""
    many = [f"/p{i // 2}" for i in range(3000)]
    rows = [("https://a/", ["mailto:x@y", None, "#f", "/b/", "/b", "c"]), ("https://m/", many), ("https://m/", ["/z", *many[:9]]), ("https://none/", ["mailto:x"]), ("https://e/", []), ("https://n/", None), (None, ["https://x/"])]
    df = spark.createDataFrame(rows, "url string, links array<string>").repartition(2)
    got = {r.url: r.edges for r in distil.edges_of(df).collect()}
    key = lambda u: urls.url_key(u) % (1 << 64)
    first = ["https://m/z", *[f"https://m/p{i}" for i in range(63)]]
    want = {"https://a/": ["https://a/", "https://a/b", "https://a/c"], "https://m/": first}
    assert {u: [k % (1 << 64) for k in e] for u, e in got.items()} == {u: sorted(map(key, e)) for u, e in want.items()}
    assert "Generate" not in distil.edges_of(df)._jdf.queryExecution().executedPlan().toString()


def test_batches_of_python_functions_are_small(spark):
    """A worker holds a few MB of texts at a time, whatever the number of rows of a partition."""

    @udf.arrow_function("long")
    def size_of_batch(texts):
        return texts.map(len).mul(0) + int(texts.map(len).sum())

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    assert rows.select(size_of_batch("t").alias("n")).agg(F.max("n")).first()[0] <= udf.BATCH_BYTES * 1.1


def test_chunks_of_a_batch_of_pages(spark):
    """Facts of pages come back in chunks, not a batch at once; null, empty, binary and long pages too."""
    pages = [f"<title>t{i}</title><h2>h{i}</h2><p>{'w ' * i}</p>" for i in range(900)] + [None, "", "<p>" + "x " * (udf.CHUNK_BYTES + 9)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1)
    want = [html.page_facts(p or "") for p in pages]
    for column in ("html", "cast(html AS binary)"):
        found = df.select("i", html.page_facts_udf(F.expr(column)).alias("f")).orderBy("i").collect()
        assert [r.f.asDict() for r in found] == want

    @udf.chunked_function("array<long>", pa.list_(pa.int64()))
    def mapped(text):
        return [pa.total_allocated_bytes()]

    large = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    assert large.select(mapped("t")[0].alias("n")).agg(F.max("n")).first()[0] < 4 * udf.BATCH_BYTES


def test_crawl_makes_its_site_once(spark):
    """A site that is dear to make is made once, not once for each level."""
    made = spark.sparkContext.accumulator(0)

    def body(i):
        made.add(1)
        return f'<a href="/{i + 1}">n</a><a href="/0">n</a>'.encode()

    rows = spark.range(8).select(F.concat(F.lit("https://h/"), "id").alias("url"), F.lit("html").alias("kind"), F.udf(body, "binary")("id").alias("body"), F.lit(200).alias("status"), F.lit("e").alias("etag"))
    found = crawl.crawl(rows, "https://h/0", crawl.CrawlConfig(5, 1000, scope="host")).select("url", "depth", "outcome").collect()
    assert sorted(map(tuple, found)) == [(f"https://h/{i}", i, "fetched") for i in range(6)]
    assert made.value == 8


def test_crawl_levels_send_keys_to_the_site(spark, monkeypatch):
    """Neither the site nor the known links are shuffled for a level; the ways for large levels give the same rows."""
    plans = []
    write = crawl.materialise

    def watched(df, label):
        if re.fullmatch(r"crawl-\d+", label):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(crawl, "materialise", watched)
    body = F.concat(*[F.concat(F.lit(f'<a href="/{k}'), F.col("id") * k % 40, F.lit('">n</a>')) for k in (2, 3)], F.lit('<a href="/x.png">n</a><a href="/gone">n</a>')).cast("binary")
    rows = spark.range(400).select(F.concat(F.lit("https://h/"), "id").alias("url"), F.lit("html").alias("kind"), body.alias("body"), F.lit(200).alias("status"), F.lit("e").alias("etag"))
    keyed = rows.withColumn("url_key", urls.url_key_udf("url")).where("substring(url, -1) IN ('2', '6')")
    known = keyed.select("url_key", F.lit("e").alias("etag"))
    edges = keyed.select("url_key", F.array(F.lit("https://h/7"), F.lit(None), F.lit("https://h/gone"), F.concat("url", F.lit("0"))).alias("children"))
    run = lambda most: sorted(map(tuple, crawl.crawl(rows, "https://h/1", crawl.CrawlConfig(3, most, scope="host"), known, edges).select("url", "depth", "place", "outcome", "yielded").collect()))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = [run(1000), run(5)]
        assert plans and all(p.count("LeftSemi") >= 1 for p in plans)
        monkeypatch.setattr(crawl, "SENT_KEYS", 0)
        monkeypatch.setattr(crawl, "ONE_TASK", 0)
        assert [run(1000), run(5)] == found
    finally:
        spark.conf.set(threshold, before)
    whole, cut = found
    assert {r[3] for r in whole} == {"fetched", "revalidated", "failed"} and sum(r[3] == "fetched" for r in cut) == 5 < sum(r[3] == "fetched" for r in whole)


def test_grams_are_counted_within_documents(spark):
    """As by a grouping of all grams: repeated and null ids, short tokens, characters beyond the first plane."""
    rows = [(1, ["aaaa", "ab", "c", "𝒳𝒴𝒵𝒳"]), (1, ["aaa", "über"]), (None, ["null"]), (2, []), (3, None), (4, ["x"] * 500)]
    df = spark.createDataFrame(rows, "doc_id long, t array<string>").repartition(3)
    for n in (1, 2, 3):
        want = df.select("doc_id", F.explode("t").alias("t")).select("doc_id", F.explode(text.char_ngrams(F.col("t"), n)).alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))
        found = text.gram_counts(df, "doc_id", "t", n)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert not re.search(r"hashpartitioning\([^)]*gram", found._jdf.queryExecution().executedPlan().toString())
