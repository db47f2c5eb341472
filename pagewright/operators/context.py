"""What a page's checks need to know about its site, as columns joined onto pages.

pages: a snapshot table with site, url, title, h1, links (resolved, nofollow); one row for each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import trim_ws
from pagewright.functions.urls import is_absolute, normalize_url, url_path

LANGUAGE = "^[a-z]{2}(-[a-z]{2})?$"


def link_edges(pages: DataFrame) -> DataFrame:
    """site, page_url, pos and the fields of each link."""
    return pages.select("site", F.col("url").alias("page_url"), F.posexplode("links").alias("pos", "l")).select("site", "page_url", "pos", "l.*")


def inbound_counts(edges: DataFrame) -> DataFrame:
    """site, target (normalised) and n: links to each target from the site's own pages, self-links included."""
    target = normalize_url(F.col("resolved"))
    return edges.select("site", target.alias("target")).where("target <> ''").groupBy("site", "target").agg(F.count("*").alias("n"))


def with_inbound(pages: DataFrame) -> DataFrame:
    counts = inbound_counts(link_edges(pages)).select(F.col("site").alias("__s"), F.col("target").alias("__t"), F.col("n").alias("inbound_links"))
    j = pages.join(counts, (F.col("site") == F.col("__s")) & (normalize_url(F.col("url")) == F.col("__t")), "left").drop("__s", "__t")
    return j.withColumn("inbound_links", F.coalesce("inbound_links", F.lit(0)))


def with_sitemap(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """in_sitemap: membership in sitemap(site, url); without one, in the set of crawled URLs."""
    source = pages if sitemap is None else sitemap
    urls = source.select(F.col("site").alias("__s"), normalize_url(F.col("url")).alias("__u")).distinct().withColumn("__in", F.lit(True))
    j = pages.join(urls, (F.col("site") == F.col("__s")) & (normalize_url(F.col("url")) == F.col("__u")), "left").drop("__s", "__u")
    return j.withColumn("in_sitemap", F.coalesce("__in", F.lit(False))).drop("__in")


def signature():
    """Title and first main heading, folded; null where both are blank."""
    fold = lambda c: F.lower(trim_ws(F.coalesce(c, F.lit(""))))
    s = F.concat_ws("|", fold(F.col("title")), fold(F.get("h1", F.lit(0))))
    return F.when(s != "|", s)


def with_duplicates(pages: DataFrame) -> DataFrame:
    """competing: whether another URL of the site has the same title and main heading."""
    marked = pages.withColumn("__sig", signature())
    shared = marked.where("__sig is not null").groupBy(F.col("site").alias("__s"), F.col("__sig").alias("__g")).agg(F.min("url").alias("a"), F.max("url").alias("b")).where("a <> b").select("__s", "__g", F.lit(True).alias("__dup"))
    j = marked.join(shared, (F.col("site") == F.col("__s")) & (F.col("__sig") == F.col("__g")), "left")
    return j.withColumn("competing", F.coalesce("__dup", F.lit(False))).drop("__s", "__g", "__sig", "__dup")


def site_languages(pages: DataFrame) -> DataFrame:
    """site, languages (distinct two-letter first segments of link targets) and multilingual."""
    first = F.lower(F.get(F.filter(F.split(url_path(F.col("resolved")), "/"), lambda x: x != ""), F.lit(0)))
    codes = link_edges(pages).where(is_absolute(F.col("resolved"))).select("site", first.alias("code")).where(F.col("code").rlike(LANGUAGE)).distinct().groupBy("site").agg(F.count("*").alias("languages"))
    declared = pages.groupBy("site").agg(F.max(F.size("hreflang") > 0).alias("declared"))
    return declared.join(codes, "site", "left").select("site", F.coalesce("languages", F.lit(0)).alias("languages"), (F.col("declared") | (F.coalesce("languages", F.lit(0)) >= 2)).alias("multilingual"))


def with_context(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """pages with inbound_links, in_sitemap, competing and multilingual; a page without a site keeps its row."""
    languages = site_languages(pages).select(F.col("site").alias("__s"), "multilingual")
    j = with_duplicates(with_sitemap(with_inbound(pages), sitemap)).join(languages, F.col("site").eqNullSafe(F.col("__s")), "left").drop("__s")
    return j.withColumn("multilingual", F.coalesce("multilingual", F.lit(False)))
