import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hybridkb.functions import html, kinds, markdown, text, urls, vectors
from hybridkb.functions.embed import HashEmbedder


@pytest.mark.parametrize(
    ("given_url", "want"),
    [
        ("HTTPS://User:pw@Example.COM:443/a/b/?b=2&a=1&&#frag", "https://example.com/a/b?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com:8080/x//", "http://example.com:8080/x/"),
        ("http://example.com/a/../b/./c", "http://example.com/b/c"),
        ("http://example.com/für", "http://example.com/f%C3%BCr"),
        ("http://bücher.example/", "http://xn--bcher-kva.example/"),
        ("http:\\\\example.com\\a", "http://example.com/a"),
        (" \thttp://exa\nmple.com/ ", "http://example.com/"),
        ("http://0x7f.1/", "http://127.0.0.1/"),
        ("http://example.com/?", "http://example.com/"),
        ("no url", None),
        ("http://", None),
        ("http://a b/", None),
        (None, None),
    ],
)
def test_canonical(given_url, want):
    assert urls.canonicalise(given_url) == want


@pytest.mark.parametrize(
    ("href", "want"),
    [("b", "http://h/a/b"), ("/b?x", "http://h/b?x"), ("//k/b", "http://k/b"), ("?q", "http://h/a/p?q"), ("#f", "http://h/a/p"), ("../z", "http://h/z"), ("https://o/", "https://o/"), ("", "http://h/a/p"), ("mailto:x@y", "mailto:x@y")],
)
def test_resolve(href, want):
    assert urls.resolve("http://h/a/p", href).text(fragment=False) == want


@settings(max_examples=150, deadline=None)
@given(st.from_regex(r"[a-z]{1,6}\.dev(/[a-z0-9]{1,5}){0,3}(\?[a-z]=[0-9](&[a-z]=[0-9])?)?", fullmatch=True), st.from_regex(r"[a-z]{0,5}", fullmatch=True))
def test_canonical_is_stable(rest, fragment):
    url = "https://" + rest
    c = urls.canonicalise(url)
    assert urls.canonicalise(c) == c == urls.canonicalise(f"{url}#{fragment}")
    assert urls.url_key(url) == urls.url_key(f"HTTPS://{rest}#{fragment}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>a hrefscript!-/='\"&;#x1 ", max_size=80))
def test_links_of_anything(page):
    assert all(isinstance(x, str) and x for x in html.extract_links(page))
    html.page_facts(page)
    markdown.markdown_facts(page)


def test_title_source():
    f = html.page_facts("\n<html>\n <title>a &lt; &quot;b &amp</title><p>d&amp")
    assert (f["title"], f["title_source"]) == ('a < "b &', "a &lt; &quot;b &amp")
    assert html.page_facts("<TITLE lang='x'>A&am</TITLE><title>B</title>")["title_source"] == "A&am"
    assert html.page_facts("<title> </title>")["title_source"] is html.page_facts("<title>a")["title_source"] is html.page_facts("x")["title_source"] is None


def test_links():
    page = """<A HREF='/one'>x</A><!-- <a href="/no"> --><script>"<a href='/no'>"</script><abbr href="/no"><a class="x>y" href=/two>z</a>
    <a href = "/t?a=1&amp;b=2">q</a><a href="">e</a><a title="href">n</a><style><a href="/no"></style><a href="/last"""
    assert html.extract_links(page) == ["/one", "/two", "/t?a=1&b=2", "/last"]


def test_page():
    f = html.page_facts("<html lang='de-AT'><head><title> </title><style>p{}</style></head><body><h1>Head</h1><p>one<b>two<p>three<ul><li>x<li><a>y</a></ul><h4>deep</h4>")
    assert f["title"] == "Head" and f["lang"] == "de" and f["headings"] == ["Head"]
    assert f["body"].split() == ["Head", "one", "two", "three", "x", "y", "y", "deep"]


def test_markdown():
    f = markdown.markdown_facts("---\ntitle: 'T'\nlang: fr\n---\n# One\n##Two\n#### no\n[a](/x \"t\") ![i](/p) [h](#h) <https://e/> <http no>\n [r]: /ref\n")
    assert (f["title"], f["lang"], f["headings"], f["levels"]) == ("T", "fr", ["One", "Two"], [1, 2])
    assert f["links"] == ["/x", "https://e/", "/ref"]
    assert markdown.front_matter("---\nopen") == (None, "---\nopen")


def test_text_columns(spark):
    df = spark.createDataFrame([("Hello, World!  foo_bar.baz", "a/b"), ("", ""), (None, None), ("é" * 100 + "\nx", "/Docs/x.y.md/Docs/")], "t string, p string")
    got = df.select(text.normalized_tokens(F.col("t")), text.plain_title(F.col("t")), text.snippet(F.col("t")), text.path_tags(F.col("p")), text.keywords(text.normalized_tokens(F.col("t")))).collect()
    assert got[0][0] == ["hello", "world", "foo", "bar", "baz"] and got[0][2] == "Hello, World! foo_bar.baz"
    assert got[0][4] == ["bar", "baz", "foo", "hello", "world"]
    assert got[1][0] == [] and got[1][1] is None and got[2][0] == [] and got[2][1] is None
    assert got[3][1] == "é" * 60 and got[3][3] == ["docs", "x.y"]


def test_keywords_by_frequency(spark):
    df = spark.createDataFrame([(["zeta", "alpha", "zeta", "the", "of", "ab", "alpha", "beta", "zeta"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(text.keywords(F.col("t"))).collect()] == [["zeta", "alpha", "beta"], []]


def test_kinds(spark):
    assert [kinds.path_kind(p) for p in ("/a.HTML", "b/readme.md", "x.tar.gz", "sql", "noext", "d.d/f")] == ["html", "markdown", "unknown", "code", "unknown", "unknown"]
    df = spark.createDataFrame([("text/html; charset=x",), (None,), ("text/x-c",)], "c string")
    assert [r[0] for r in df.select(kinds.kind_from_content_type(F.col("c"))).collect()] == ["html", "unknown", "code"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    got = df.select(vectors.l2_normalize(F.col("v")), vectors.sign_words(F.col("v"), 3), vectors.int8_codes(F.col("v")), vectors.int8_scale(F.col("v"))).collect()
    assert got[0][0] == pytest.approx([0.6, -0.8, 0.0]) and got[1][0] == [0.0] * 3
    assert got[0][1] == [0b101] and got[1][1] == [0b111]
    assert got[0][2] == [95, -127, 0] and got[1][3] == 1.0


def test_embedder():
    e = HashEmbedder(64)
    a, b = e.embed("Shared words here"), e.embed_batch(["Shared words here", "", None])
    assert np.allclose(a, b[0]) and np.isclose((a * a).sum(), 1) and not b[1].any() and not b[2].any()
    assert float(a @ e.embed("shared words there")) > float(a @ e.embed("quite unlike"))


def test_batches_of_dense_queries(spark):
    from hybridkb.operators import dense

    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 5))
    v[7] = v[3]
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:20])], "query_id long, vector array<double>")
    for far in (0.0, 1e6):  # far from the origin, where products cancel
        v += far
        vecs, asked = (d.withColumn(c, F.transform(c, lambda x: x + far)) for d, c in ((vecs, "embedding"), (asked, "vector")))
        for metric in ("l2",) if far else ("dot", "l2"):
            s = v[:20] @ v.T if metric == "dot" else -((v[:20, None] - v[None]) ** 2).sum(2)
            want = {(i, r + 1): int(j) for i in range(20) for r, j in enumerate(np.lexsort((np.arange(60), -s[i].round(9)))[:4])}
            got = dense.batch_top_k(vecs, asked, 4, metric).collect()
            assert {(r.query_id, r.rank): r.doc_id for r in got} == want
    assert dense.batch_top_k(vecs, asked, 0).count() == 0
