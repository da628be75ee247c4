"""Queries over texts: terms, BM25, keywords, snippets, Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.functions import markdown, text, urls
from hybridkb.functions.embed import embed_udf
from hybridkb.operators import bm25
from hybridkb.plans.catalog import register
from hybridkb.plans.common import TERMS_SQL, kb_docs, term_docs, tok
from hybridkb.session import table

ASKED = ["the", "les", "der", "ention", "los"]
_IN = "('" + "', '".join(ASKED) + "')"
_POST = f"{TERMS_SQL}, lens AS (SELECT doc_id, len(terms) AS doc_len FROM docs), stats AS (SELECT count(*) AS n, sum(doc_len) AS total, sum(doc_len) / count(*) AS avgdl FROM lens), post AS (SELECT term, doc_id, least(count(*), 65535) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL)"
_WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / greatest(avgdl, 1)))"


def _bm25_sql(where: str = "true") -> str:
    return f"""WITH {_POST}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN {_IN} GROUP BY term),
scores AS (SELECT doc_id, sum({_WEIGHT}) AS score FROM post JOIN df USING (term) JOIN lens USING (doc_id), stats WHERE {where} GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 20"""


def _bm25(spark, sf_dir, terms, allowed=None):
    docs = term_docs(spark, sf_dir)
    asked = spark.createDataFrame([(0, t) for t in terms], "query_id long, term string")
    hits = bm25.Hits(docs, asked)
    found = bm25.top_k(bm25.score(hits.postings(), hits.stats(), asked, allowed), 20)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")


@register("tokenize_terms", f"SELECT doc_id, len({tok('text')}) AS n_terms, array_to_string({tok('text')}[1:4096], ' ') AS terms FROM documents")
def tokenize_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.normalized_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join(F.slice("t", 1, text.MAX_TERMS), " ").alias("terms"))


@register("term_freq", f"WITH {_POST} SELECT doc_id, term, tf FROM post")
def term_freq(spark, sf_dir):
    return bm25.postings(term_docs(spark, sf_dir)).select("doc_id", "term", "tf")


@register("doc_freq", f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark, sf_dir):
    return bm25.term_stats(bm25.postings(term_docs(spark, sf_dir)))


@register("corpus_stats", f"WITH {_POST} SELECT n AS doc_count, total::BIGINT AS total_len, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(term_docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@register("bm25_topk", _bm25_sql())
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, ASKED)


@register("bm25_filtered", _bm25_sql("doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def bm25_filtered(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where(F.coalesce(F.col("lang") == "en", F.lit(False))).select("doc_id")
    return _bm25(spark, sf_dir, ASKED, allowed)


@register("bm25_repeat_terms", _bm25_sql())
def bm25_repeat_terms(spark, sf_dir):
    return _bm25(spark, sf_dir, ASKED * 3)


@register(
    "bm25_batch",
    f"""WITH {_POST}, q AS (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scores AS (SELECT query_id, doc_id, sum({_WEIGHT}) AS score FROM q JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10""",
)
def bm25_batch(spark, sf_dir):
    docs = term_docs(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.normalized_tokens(F.col("text"))).alias("term"))
    return bm25.Hits(docs, asked).top_k(10, digits=6)


@register("char_ngrams", f"SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN length(t) <= 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END) AS gram FROM (SELECT doc_id, unnest({tok('text')}) AS t FROM documents)) GROUP BY ALL")
def char_ngrams(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.normalized_tokens(F.col("text")).alias("t"))
    return text.gram_counts(rows, "doc_id", "t", 3)


_STOP = "('" + "', '".join(sorted(text.STOPWORDS)) + "')"


@register(
    "keywords_topk",
    f"""WITH {_POST}, r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM post WHERE strlen(term) >= 3 AND term NOT IN {_STOP} QUALIFY rank <= 8)
SELECT docs.doc_id, coalesce(string_agg(term, ' ' ORDER BY rank), '') AS keywords FROM docs LEFT JOIN r USING (doc_id) GROUP BY docs.doc_id""",
)
def keywords_topk(spark, sf_dir):
    return term_docs(spark, sf_dir).select("doc_id", F.array_join(text.keywords(F.col("terms")), " ").alias("keywords"))


@register("snippet", r"SELECT doc_id, trim(substring(ltrim(regexp_replace(text, '\s+', ' ', 'g')), 1, 180)) AS snippet FROM documents")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


_FIRST_LINE = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '')[1]"
_CUT_LINE = "CASE WHEN strlen(line) <= 120 THEN line ELSE list_last(list_filter(list_transform(range(1, 121), lambda i: substring(line, 1, i)), lambda s: strlen(s) <= 120)) END"


@register("plain_title", f"SELECT doc_id, {_CUT_LINE} AS title FROM (SELECT doc_id, {_FIRST_LINE} AS line FROM documents)")
def plain_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.plain_title(F.col("text")).alias("title"))


@register("embed_text", rf"WITH b AS (SELECT doc_id, source, lang, substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 1000) AS body FROM documents) SELECT doc_id, source || ' ' || lang || ' ' || body AS embed_text FROM b")
def embed_text(spark, sf_dir):
    return kb_docs(spark, sf_dir).select("doc_id", F.concat(F.array_join("tags", " "), F.lit(" "), text.prefix(F.col("text"))).alias("embed_text"))


@register("path_tags", r"SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ' ') AS tags FROM (SELECT page_id, list_filter(list_transform(string_split(CASE WHEN p = '' THEN '/' ELSE p END, '/'), lambda s: lower(regexp_replace(trim(s), '\.[^.]*$', ''))), lambda s: strlen(s) >= 2) AS l FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]*(/[^?#]*)', 1) AS p FROM pages))")
def path_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.path_tags(urls.url_path(F.col("url"))), " ").alias("tags"))


@register("doc_terms_rebuild", f"WITH {_POST} SELECT doc_id, array_to_string(list_sort(terms), ' ') AS terms FROM docs WHERE len(terms) > 0")
def doc_terms_rebuild(spark, sf_dir):
    return bm25.rebuild_terms(bm25.postings(term_docs(spark, sf_dir))).select("doc_id", F.array_join("terms", " ").alias("terms"))


@register("hash_embed")
def hash_embed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embed_udf()(text.prefix(F.col("text"))).alias("embedding"))


def _as_markdown(spark, sf_dir):
    """Documents as Markdown: front matter, a heading of each level, two links and an image."""
    head = F.concat(F.lit("---\ntitle: \"Document "), F.col("doc_id"), F.lit("\"\nlang: "), F.col("lang"), F.lit("\n---\n# Part "), F.col("source"), F.lit("\n## Text\n#### deep\n"))
    tail = F.concat(F.lit("\n[next](/d/"), F.col("doc_id") + 1, F.lit(" \"n\") ![pic](/p.png) <https://example.com/"), F.col("source"), F.lit("> [top](#top)\n[r]: /ref/"), F.col("lang"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.regexp_replace("text", r"[#\[\]<>(]", " "), tail).alias("md"))


@register("markdown_front_matter", "SELECT doc_id, 'Document ' || doc_id AS title, lang, 'Part ' || source || '|Text' AS headings, '1|2' AS levels FROM documents")
def markdown_front_matter(spark, sf_dir):
    f = _as_markdown(spark, sf_dir).select("doc_id", markdown.markdown_head_udf("md").alias("f"))
    return f.select("doc_id", "f.title", "f.lang", F.array_join("f.headings", "|").alias("headings"), F.array_join(F.transform("f.levels", lambda x: x.cast("string")), "|").alias("levels"))


@register("markdown_links", "SELECT doc_id, '/d/' || (doc_id + 1) || ' https://example.com/' || source || ' /ref/' || lang AS links FROM documents")
def markdown_links(spark, sf_dir):
    return _as_markdown(spark, sf_dir).select("doc_id", F.array_join(markdown.markdown_facts_udf("md")["links"], " ").alias("links"))
