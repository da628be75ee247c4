"""URL filter by empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host. Rates are shrunk through beta-binomial priors in
three steps: suffix towards the corpus, registered domain towards its suffix, host towards its
registered domain. At each step the prior's strength comes from the spread between siblings beyond
binomial noise (moment estimate of the intraclass correlation). A page is dropped where the lower
posterior bound of its host's bad rate exceeds a threshold.

Scale: pages are read for (page_id, url) alone, and one row a host is written before anything is
estimated from it; domains and suffixes are sums of those rows, and each step's strength is one number.
No step needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.session import materialise, pick

#: Suffixes of more than one label under which the public registers; any other suffix is the last label.
#: ``read_suffixes`` reads a full list.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.nz", "co.za", "com.mx", "com.tr")
THRESHOLD, Z = 0.2, 1.645
#: Bad rate expected without any label, worth one label.
PRIOR_RATE = 0.1


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null for what has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    bare = F.rtrim(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(F.lower(bare), r"\.+$", "")
    return F.when(host != "", host)


def read_suffixes(path: str) -> tuple[str, ...]:
    """Suffixes of a file in the public suffix format: one rule a line, // before comments, * for any
    label. Rules of one label and exceptions (!) are left out, as the last label is a suffix anyway."""
    with open(path, encoding="utf-8") as f:
        rules = [x.split()[0].lower() for x in f if x.strip() and not x.startswith("//")]
    return tuple(r for r in rules if "." in r and not r.startswith("!"))


def suffix_pattern(suffixes: tuple[str, ...] = LONG_SUFFIXES) -> str:
    """The first place from which a known suffix, or else the last label, reaches the end."""
    known = "|".join(x.replace(".", r"\.").replace("*", "[^.]+") for x in suffixes)
    return rf"(?:^|\.)({known + '|' if known else ''}[^.]+)$"


def suffix_of(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    return F.regexp_extract(host, suffix_pattern(suffixes), 1)


def domain_of(host: Column, suffix: Column) -> Column:
    """Suffix and one more label; the host itself where there is none."""
    rest = F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    label = F.regexp_extract(rest, r"([^.]+)$", 1)
    return F.when(label == "", host).otherwise(F.concat(label, F.lit("."), suffix))


def _shrink(level: DataFrame) -> DataFrame:
    """Adds the posterior (a, b) of rows with n, k and the parent's mean ``mu``."""
    v = F.col("mu") * (1 - F.col("mu"))
    off = F.col("k") / F.col("n") - F.col("mu")
    sums = level.where("n > 0").agg(F.sum(F.col("n") * off * off).alias("spread"), F.sum(v).alias("noise"), F.sum(v * (F.col("n") - 1)).alias("room"))
    rho = F.when(F.col("room") > 0, F.greatest(F.lit(0.001), F.least(F.lit(0.99), (F.col("spread") - F.col("noise")) / F.col("room")))).otherwise(F.lit(0.001))
    m = F.lit(sums.select((1 / rho - 1).alias("m")).first().m)
    return level.withColumns({"a": F.col("mu") * m + F.col("k"), "b": (1 - F.col("mu")) * m + F.col("n") - F.col("k")}).drop("mu")


def host_reputation(pages: DataFrame, labels: DataFrame, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, k, a, b) for every host of ``pages``; n labelled pages, k of them bad."""
    hosted = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host")).where("host IS NOT NULL")
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long"))
    outcome = pick(labels, "doc_id", "quality", "toxic").select("doc_id", bad.alias("bad")).where("doc_id IS NOT NULL AND bad IS NOT NULL").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    counts = hosted.join(outcome, F.col("page_id") == F.col("doc_id"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = counts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = materialise(hosts, "hosts")
    domains = materialise(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = domains.agg(((F.coalesce(F.sum("k"), F.lit(0)) + PRIOR_RATE) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mu")).first().mu
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mu")
    tops = materialise(_shrink(tops.withColumn("mu", F.lit(whole))).select("suffix", mean), "suffix-rates")
    domains = materialise(_shrink(domains.join(tops, "suffix")).select("domain", mean), "domain-rates")
    return materialise(_shrink(hosts.join(domains, "domain")), "host-rates")


def filter_urls(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, z: float = Z, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """(page_id, host, n_labelled, bad_mean, bad_low, keep) for every page.

    A label's outcome is bad if its quality is 0 or it is toxic; ``labels.doc_id`` names the page.
    Repeated labels of one page count once, the worst of them; labels with neither outcome count
    not at all. A page is kept unless the lower bound ``mean - z * deviation`` of its host's bad
    rate exceeds ``threshold``. Pages whose URL is null or has no host have null statistics and
    are kept. Repeated pages keep their rows. Empty pages give no rows; without labels all is kept. URLs
    of any length are read; further columns are ignored.
    """
    rep = host_reputation(pages, labels, suffixes)
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    low = F.greatest(F.lit(0.0), mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    scored = rep.select(F.col("host").alias("_host"), F.col("n").alias("n_labelled"), F.round(mean, 6).alias("bad_mean"), F.round(low, 6).alias("bad_low"))
    rows = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"))
    return rows.join(scored, F.col("host") == F.col("_host"), "left").select("page_id", "host", "n_labelled", "bad_mean", "bad_low", (F.coalesce("bad_low", F.lit(0.0)) <= threshold).alias("keep"))


def oracle(threshold: float = THRESHOLD, z: float = Z, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> str:
    def step(name: str, src: str, mu: str) -> str:
        return f"""
{name}_in AS (SELECT s.*, {mu}),
{name}_rho AS (SELECT sum(n * (k::DOUBLE / n - mu) * (k::DOUBLE / n - mu)) AS spread, sum(mu * (1 - mu)) AS noise,
    sum(mu * (1 - mu) * (n - 1)) AS room FROM {name}_in WHERE n > 0),
{name}_m AS (SELECT 1 / (CASE WHEN room > 0 THEN greatest(0.001, least(0.99, (spread - noise) / room)) ELSE 0.001 END) - 1 AS m FROM {name}_rho),
{name} AS (SELECT i.*, i.mu * m + k AS a, (1 - i.mu) * m + n - k AS b FROM {name}_in i, {name}_m)"""

    return f"""
WITH hosted AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_replace(regexp_replace(
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\\.+$', ''), '') AS host FROM pages),
outcome AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
counts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM hosted LEFT JOIN outcome ON page_id = doc_id WHERE host IS NOT NULL GROUP BY host),
suffixed AS (SELECT *, regexp_extract(host, '{suffix_pattern(suffixes)}', 1) AS suffix FROM counts),
hosts AS (SELECT *, CASE WHEN regexp_extract(left(host, greatest(length(host) - length(suffix) - 1, 0)), '([^.]+)$', 1) = '' THEN host
    ELSE regexp_extract(left(host, greatest(length(host) - length(suffix) - 1, 0)), '([^.]+)$', 1) || '.' || suffix END AS domain FROM suffixed),
domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY suffix, domain),
tops AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY suffix),
whole AS (SELECT (coalesce(sum(k), 0) + {PRIOR_RATE}) / (coalesce(sum(n), 0) + 1.0) AS mu FROM tops),
{step("s1", "tops", "w.mu AS mu FROM tops s, whole w").strip()},
{step("s2", "domains", "a / (a + b) AS mu FROM domains s JOIN (SELECT suffix AS sx, a, b FROM s1) ON sx = s.suffix").strip()},
{step("s3", "hosts", "a / (a + b) AS mu FROM hosts s JOIN (SELECT domain AS dm, a, b FROM s2) ON dm = s.domain").strip()},
scored AS (SELECT host, n AS n_labelled, round(a / (a + b), 6) AS bad_mean,
    round(greatest(0.0, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS bad_low FROM s3)
SELECT h.page_id, h.host, n_labelled, bad_mean, bad_low, coalesce(bad_low, 0.0) <= {threshold} AS keep
FROM hosted h LEFT JOIN scored USING (host)"""
