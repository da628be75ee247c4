import math
import random
import re
import numpy as np
from pyspark.sql import functions as F

from hybridkb.llm.html_content import LineEvents, content_lines, extract_content, extract_pages, gaussian

LONG = "This paragraph is long enough to be taken as content by its text to tag ratio. " * 4
PAGE = f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>aa</a><li><a href=/b>bb</a></ul></nav><article><p>{LONG}</p><p>{LONG} &amp; more</p><p>{LONG}</p></article><footer><a href=/c>cc</a></footer></body></html>"


def test_article_is_kept_and_navigation_dropped():
    text, kept, lines = extract_content(PAGE)
    assert text.count("This paragraph") == 12 and "& more" in text
    assert "aa" not in text and "var a" not in text and "cc" not in text
    assert 3 <= kept < lines


def test_ratios_by_line():
    p = LineEvents()
    p.feed("<p>abc<b>d</b></p>x\ny")
    assert p.finish() == [("abc d", 4), ("x", 0), ("y", 0)]


def test_smoothing_against_the_plain_sum():
    rng = np.random.default_rng(1)
    r = rng.random(17)
    want = []
    for i in range(17):
        w = [np.exp(-0.5 * ((i - j) / 1.5) ** 2) if abs(i - j) <= 5 else 0 for j in range(17)]
        want.append(sum(a * b for a, b in zip(w, r)) / sum(w))
    assert np.allclose(gaussian(r, 1.5), want)
    assert len(gaussian(np.array([3.0]), 1.0)) == 1


def test_equal_ratios_keep_every_line():
    assert content_lines([("abc", 1), ("abd", 1)], 1.0, 1.0) == ["abc", "abd"]


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", "<<<<p <a href='" + "x" * 200000), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<![CDATA[x]]><!doctype"), (6, "u", f"<p>{'long text ' * 200000}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit("clash"))
    got = extract_pages(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].content == "" and by[1].n_lines == 0 and by[4].content == "plain" and len(by[6].content) == 1999999
    assert extract_pages(pages.limit(0)).count() == 0


def naive(html, sigma=1.0, weight=1.0):
    """Brute force for markup of plain block tags: a line for each, ratios smoothed one by one."""
    lines = []
    for piece in re.split(r"(?=<p>|<div>|<li>)|(?<=</p>)|(?<=</div>)|(?<=</li>)|\n", html):
        text, tags = " ".join(re.sub(r"<[^>]*>", "", piece).split()), len(re.findall(r"<[^>]*>", piece))
        if text or tags:
            lines.append((text, tags))
    ratio = [len(t) / max(1, k) for t, k in lines]
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-0.5 * ((i - j) / sigma) ** 2), r) for j, r in enumerate(ratio) if abs(i - j) <= max(1, math.ceil(3 * sigma))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    edge = weight * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return [t for (t, _), x in zip(lines, smooth) if t and x > edge]


def test_pages_against_brute_force(spark):
    r = random.Random(12)
    pages = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 30)):
            tag, words = r.choice(["p", "div", "li"]), " ".join(r.choice(["one", "twelve", "of", "it"]) for _ in range(r.choice([0, 1, 2, 30, 80])))
            parts.append(f"<{tag}>" + (f"<a href='x'><b>{words}</b></a>" if r.random() < 0.4 else words) + f"</{tag}>" + r.choice(["", "\n"]))
        pages.append((i, f"https://h/{i}", "".join(parts)))
    got = {x.page_id: x.content for x in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(naive(h)) for i, _, h in pages}


def test_tags_that_nothing_closes():
    after = "<p>later text of the page, which is long enough to be content of it</p>" * 3
    for tag in ("noscript", "template"):
        assert "later text" in extract_content(f"<body><p>a</p><{tag}>x" + after + "</body>")[0]
        assert "later text" in extract_content(f"<body><{tag}><p>x</body>" + after)[0]
        closed = extract_content(f"<body><{tag}><p>hidden words that nobody reads at all</p></{tag}>" + after + "</body>")[0]
        assert "hidden" not in closed and "later text" in closed
    assert "later" not in extract_content("<p>a</p><script>x" + after)[0]
