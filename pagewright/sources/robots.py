"""robots.txt and sitemap files as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.text import trim_ws
from pagewright.functions.urls import host_of

MOST_SITEMAPS = 50


def parse_robots(body: Column) -> Column:
    """sitemaps and disallow of a robots.txt: lines of any user agent, comment lines skipped, an empty rule kept as ''."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), trim_ws), lambda x: (x != "") & ~x.startswith("#"))
    of = lambda key: F.transform(F.filter(lines, lambda x: x.rlike(f"(?i)^{key}:")), lambda x: trim_ws(F.regexp_replace(x, f"(?i)^{key}:", "")))
    return F.struct(of("sitemap").alias("sitemaps"), of("disallow").alias("disallow"))


def parse_sitemap(xml: Column) -> Column:
    """The trimmed contents of all loc elements."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit("(?i)<loc>([^<]+)</loc>"), F.lit(1)), trim_ws)


def sitemap_kind(xml: Column) -> Column:
    return F.when(F.coalesce(xml, F.lit("")).rlike(r"(?i)<sitemapindex(?![A-Za-z0-9_])"), "index").otherwise("urlset")


def allowed(path: Column, disallow: Column) -> Column:
    """Whether no non-empty rule is a prefix of the path. Crawls enforce this as an option only."""
    return ~F.exists(disallow, lambda d: (d != "") & path.startswith(d))


def expand_sitemaps(spark: SparkSession, fetched: Callable[[DataFrame, int], DataFrame], roots: list[str], hosts: list[str], most: int = MOST_SITEMAPS) -> tuple[DataFrame, dict]:
    """(url, ordinal) of the pages that sitemaps reachable from the roots list, and counters.

    fetched(frontier, n) gives the n-th generation's frontier(url, o) with a column body, null where there is none, as a
    written table; bodies stay in it, and the driver sees counts alone. Indexes are opened first in, first out, each URL
    once, `most` at most; pages on other hosts are dropped. A generation is one table, so a wide index costs no more
    steps than a small one. Ordinals rise with the place of the sitemap and the place in it, with gaps.
    """
    listed = [(u, i) for i, u in enumerate(dict.fromkeys(roots))]
    frontier = spark.createDataFrame(listed, "url string, at long").select("url", F.struct(F.lit(0).cast("long").alias("file"), F.col("at")).alias("o"))
    seen, pages, n, opened, indexes, generation = frontier.select("url"), None, 0, 0, 0, 0
    while n < most:
        got = fetched(frontier.orderBy("o").limit(most - n), generation)
        generation += 1
        asked, there, index = got.agg(F.count("*"), F.count_if(F.col("body") != ""), F.count_if((F.col("body") != "") & (sitemap_kind(F.col("body")) == "index"))).first()
        if not asked:
            break
        # at most `most` rows, so one window numbers them
        numbered = got.where("body <> ''").select((F.row_number().over(Window.orderBy("o")) + n).cast("long").alias("file"), sitemap_kind(F.col("body")).alias("kind"), parse_sitemap(F.col("body")).alias("locs"))
        read = numbered.select("file", "kind", F.posexplode("locs").alias("pos", "url"))
        n, opened, indexes = n + asked, opened + there, indexes + index
        found = read.where("kind = 'urlset'").where(host_of(F.col("url")).isin(hosts)).select("url", (F.shiftleft("file", 32) + F.col("pos")).alias("ordinal"))
        pages = found if pages is None else pages.unionByName(found)
        places = read.where("kind = 'index'").groupBy("url").agg(F.min(F.struct("file", F.col("pos").cast("long").alias("at"))).alias("o"))
        frontier = places.join(seen, "url", "left_anti")
        seen = seen.union(frontier.select("url"))
    if pages is None:
        return spark.createDataFrame([], "url string, ordinal long"), {"sitemaps": opened, "asked": n, "indexes": indexes, "entries": 0}
    return pages.groupBy("url").agg(F.min("ordinal").alias("ordinal")), {"sitemaps": opened, "asked": n, "indexes": indexes, "entries": pages.count()}


def from_table(files: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """fetched for expand_sitemaps(), from a table files(url, body) of what is at hand."""
    return lambda frontier, n: frontier.join(files.select("url", "body"), "url", "left")
