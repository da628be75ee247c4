"""Distillation of fetched resources into descriptors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.functions import html, markdown, text, urls
from hybridkb.functions.udf import arrow_function

_FACTS = "struct<title:string,lang:string,headings:array<string>,levels:array<int>,body:string,links:array<string>>"


def file_name(path: Column) -> Column:
    """The last segment that isn't empty, else null."""
    return F.get(F.reverse(F.filter(F.split(path, "/"), lambda s: s != "")), F.lit(0))


class Extractor:
    """What a further kind of resource is read by: ``kinds`` that it handles, and ``extract``, which adds to
    rows (url, kind, body binary, …) the column ``facts`` (title, lang, headings, levels, body, links)."""

    kinds: frozenset[str] = frozenset()

    def extract(self, df: DataFrame) -> DataFrame:
        raise TypeError(f"{type(self).__name__} has no extract()")


def facts(df: DataFrame, extractors: Sequence[Extractor] = ()) -> DataFrame:
    """(url, kind, body binary, …) with ``facts``: title, lang, headings, levels, body, links by kind.

    Each kind is read by its own branch, so that a page goes through one Python function at most and
    code and plain text through none. ``extractors`` come first, the earlier before the later."""
    done, taken = [], set()
    for x in extractors:
        own = sorted(set(x.kinds) - taken)
        if own:
            done.append(x.extract(df.where(F.col("kind").isin(own))).withColumn("facts", F.col("facts").cast(_FACTS)))
            taken |= set(own)
    if taken:
        df = df.where(F.col("kind").isNull() | ~F.col("kind").isin(sorted(taken)))
    body = F.coalesce(F.decode(F.col("body"), "UTF-8"), F.lit(""))
    none = F.array().cast("array<string>")
    web = df.where("kind = 'html'").withColumn("_f", html.page_facts_udf("body")).withColumn("_l", html.links_udf("body"))
    web = web.withColumn("facts", F.struct("_f.title", "_f.lang", "_f.headings", "_f.levels", "_f.body", F.col("_l").alias("links")).cast(_FACTS)).drop("_f", "_l")
    mark = df.where("kind = 'markdown'").withColumn("facts", markdown.markdown_facts_udf("body"))
    rest = df.where("kind IS NULL OR kind NOT IN ('html', 'markdown')")
    title = F.when(F.col("kind") == "code", file_name(urls.url_path(F.col("url")))).otherwise(text.plain_title(body))
    plain = rest.withColumn("facts", F.struct(title.alias("title"), F.lit(None).cast("string").alias("lang"), none.alias("headings"), F.array().cast("array<int>").alias("levels"), body.alias("body"), none.alias("links")).cast(_FACTS))
    for x in (web, mark):
        plain = plain.unionByName(x)
    for x in done:
        plain = plain.unionByName(x)
    return plain


def distil(df: DataFrame, extractors: Sequence[Extractor] = ()) -> DataFrame:
    """``df`` (url, kind, body) with title, lang, headings, heading_levels, keywords, tags, snippet, terms,
    embed_text and links. Terms are those of the title, the headings and the body's first 4096, cut to 4096."""
    f = facts(df, extractors)
    c = F.col
    joined = F.concat_ws("\n", F.coalesce(c("facts.title"), F.lit("")), F.array_join("facts.headings", "\n"))
    f = f.withColumn("terms", F.slice(F.concat(text.normalized_tokens(joined), text.capped_terms(c("facts.body"))), 1, text.MAX_TERMS))
    f = f.withColumns({"keywords": text.keywords(c("terms")), "tags": text.path_tags(urls.url_path(c("url")))})
    head = F.array_join(F.concat(F.filter(F.array(c("facts.title")), lambda x: x.isNotNull()), c("facts.headings"), c("keywords"), c("tags")), " ")
    f = f.withColumns(
        {
            "title": c("facts.title"),
            "lang": c("facts.lang"),
            "headings": F.slice(c("facts.headings"), 1, text.MAX_HEADINGS),
            "heading_levels": c("facts.levels"),
            "snippet": text.snippet(c("facts.body")),
            "embed_text": F.concat(head, F.when(head != "", " ").otherwise(""), text.prefix(c("facts.body"))),
            "links": c("facts.links"),
        }
    )
    return f.drop("facts")


@arrow_function("array<struct<pos:int,key:long>>")
def _first_keys_udf(bases: pd.Series, links: pd.Series, caps: pd.Series) -> pd.Series:
    """Place and key of the first distinct http(s) links of each row, until there are as many as the cap."""

    def one(base, hrefs, cap):
        found, tried = {}, set()
        at = urls.parse(base) if isinstance(base, str) else None
        for pos, href in enumerate([] if hrefs is None or not isinstance(base, str) else hrefs):
            if len(found) >= cap:
                break
            if href is None or href in tried:
                continue
            tried.add(href)
            u = urls.resolve(at or "", href)
            if u and u.scheme in ("http", "https") and (key := urls.url_key(u.text(fragment=False))) is not None:
                found.setdefault(key, pos)
        return [{"pos": p, "key": k} for k, p in found.items()]

    return pd.Series([one(b, h, c) for b, h, c in zip(bases, links, caps)], dtype=object)


def edges_of(df: DataFrame, cap: int = 64) -> DataFrame:
    """(url, edges): the canonical keys of http(s) links, distinct in document order, the first ``cap``, in unsigned order.

    Links are read within their row and only until the cap is reached, so that ``cap`` keys a row at most are shuffled; of
    rows that repeat a URL the places count together."""
    first = df.select("url", _first_keys_udf("url", "links", F.lit(cap)).alias("x")).where("url IS NOT NULL AND size(x) > 0")
    sorted_keys = F.array_distinct(F.transform(F.sort_array(F.flatten(F.collect_list("x"))), lambda s: s["key"]))
    unsigned = F.transform(F.slice(sorted_keys, 1, cap), lambda k: F.struct((k < 0).alias("high"), k.alias("key")))
    return first.groupBy("url").agg(F.transform(F.sort_array(unsigned), lambda s: s["key"]).alias("edges"))


def outline(headings: Column, levels: Column) -> Column:
    """(depth, text) of headings; where no level is known the first is 1, the second 2, all others 3."""
    return F.transform(headings, lambda h, i: F.struct(F.coalesce(F.get(levels, i), F.least(i, F.lit(2)) + 1).cast("int").alias("depth"), h.alias("text")))
