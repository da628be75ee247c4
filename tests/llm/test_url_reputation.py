import duckdb
import pandas as pd
from pyspark.sql import functions as F

from hybridkb.llm.url_reputation import domain_of, filter_urls, host_of, oracle, read_suffixes, suffix_of

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def data():
    pages, labels = [], []
    for i in range(400):
        host = ["good.example.com", "bad.example.net", "www.bad.example.net", "x.co.uk", "deep.a.b.org"][i % 5]
        pages.append((i, f"https://{host}/p/{i}?q=1", "<p>"))
        if i % 2:
            labels.append((i, 0 if "bad" in host and i % 3 else 1, 0))
    pages += [(900, None, None), (901, "no url", ""), (None, "http://good.example.com", ""), (902, "HTTP://user:pw@GOOD.example.com.:8080/", ""), (903, "http://new.bad.example.net/", ""), (0, pages[0][1], "<p>")]
    labels += [(1, 1, 1), (1, None, None), (None, 0, 0), (2, None, None), (4, None, 1)]
    return pages, labels


def test_parts(spark):
    rows = [("http://a.b.co.uk/x", "a.b.co.uk", "co.uk", "b.co.uk"), ("https://U@Ex.COM:1?q", "ex.com", "com", "ex.com"), ("x", None, None, None), ("http://localhost", "localhost", "localhost", "localhost")]
    for url, host, suffix, domain in rows:
        h = host_of(F.lit(url))
        got = spark.range(1).select(h.alias("h"), suffix_of(h).alias("s"), domain_of(h, suffix_of(h)).alias("d")).first()
        assert (got.h, got.d) == (host, domain)
        assert got.s == suffix


def test_matches_sql_and_blocks_bad_hosts(spark):
    p, la = data()
    got = filter_urls(spark.createDataFrame(p, PAGES), spark.createDataFrame(la, LABELS)).collect()
    pages = pd.DataFrame(p, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})  # noqa: F841
    labels = pd.DataFrame(la, columns=["doc_id", "quality", "toxic"]).astype("Int64")  # noqa: F841
    c = duckdb.connect()
    c.register("pages", pages)
    c.register("labels", labels)
    want = c.execute(oracle()).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(key(tuple(r)) for r in got) == sorted(key(r) for r in want)
    kept = {r.page_id: r.keep for r in got}
    assert not kept[1] and not kept[2] and kept[5] and kept[900] and kept[901]
    assert not kept[903], "an unseen host inherits its registered domain's reputation"


def test_empty_and_clashing(spark):
    p, la = data()
    pages, labels = spark.createDataFrame(p, PAGES), spark.createDataFrame(la, LABELS)
    assert filter_urls(pages.limit(0), labels).count() == 0
    assert filter_urls(pages, labels.limit(0)).where("NOT keep").count() == 0
    clash = pages.withColumns({"host": F.lit("z"), "n": F.lit(1), "mu": F.lit(0.5), "keep": F.lit(False)})
    assert sorted(map(str, filter_urls(clash, labels).collect())) == sorted(map(str, filter_urls(pages, labels).collect()))


def test_a_suffix_file_and_long_urls(spark, tmp_path):
    (tmp_path / "suffixes.dat").write_text("// comment\ncom\nco.uk\n*.ck\n!www.ck\nblog.host.com\n")
    rules = read_suffixes(str(tmp_path / "suffixes.dat"))
    assert rules == ("co.uk", "*.ck", "blog.host.com")
    for host, suffix in [("a.b.co.uk", "co.uk"), ("x.y.z.ck", "z.ck"), ("me.blog.host.com", "blog.host.com"), ("host.com", "com")]:
        assert spark.range(1).select(suffix_of(F.lit(host), rules).alias("s")).first().s == suffix
    p, la = data()
    long = [(5000, "https://bad.example.net/" + "x/" * 200_000, None)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(p + long, PAGES), spark.createDataFrame(la, LABELS), suffixes=rules).collect()}
    assert got[5000].host == "bad.example.net" and not got[5000].keep
