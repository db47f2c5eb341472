"""Sets of URLs: selection, sampling, canonical de-duplication, first-seen trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import host_of, normalize_url, site_of
from pagewright.operators.sampling import seeded_sample


def select_urls(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages whose normalised URL is among wanted(url)."""
    w = wanted.select(normalize_url(F.col("url")).alias("__n")).where("__n <> ''").distinct()
    return pages.withColumn("__p", normalize_url(F.col("url"))).join(w, F.col("__p") == F.col("__n"), "left_semi").drop("__p")


def choose_pages(pages: DataFrame, everything: bool = False, wanted: DataFrame | None = None, sample: int | None = None, seed: int = 42, order: str = "page_id") -> DataFrame:
    """All pages, those of a list, or a seeded sample, in this order of precedence; all if nothing is asked for."""
    if everything:
        return pages
    if wanted is not None:
        return select_urls(pages, wanted)
    return seeded_sample(pages, sample, seed, order).drop("place") if sample else pages


def sample_pages(pages: DataFrame, n: int = 25, seed: int = 42) -> DataFrame:
    """n pages in the order of a seeded hash of the URL: the same for any partitioning, a top-k of small rows."""
    key = F.sha1(F.concat(F.coalesce("url", F.lit("")), F.lit(str(seed))))
    ids = pages.select("page_id", key.alias("__k")).orderBy("__k", "page_id").limit(n).select("page_id")
    return pages.join(F.broadcast(ids), "page_id", "left_semi")


def host_filter(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """Pages on allowed hosts, in any case of letters."""
    return pages.where(host_of(F.col("url")).isin([h.lower() for h in hosts]))


def dedupe_canonical(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """canonical_key and, of all pages with that key, the first by `order`: the canonical URL, or else the page's own."""
    own = F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.col("url")) if "canonical" in pages.columns else F.col("url")
    keyed = pages.withColumn("canonical_key", normalize_url(own)).where("canonical_key <> ''")
    first = keyed.groupBy("canonical_key").agg(F.min(F.struct(order, "url")).alias("x"), F.count("*").alias("copies"))
    return first.select("canonical_key", f"x.{order}", "x.url", "copies")


def merge_url_tree(tree: DataFrame, run: DataFrame) -> DataFrame:
    """tree(site, url, first_seen, first_status) with the URLs of run(site, url, run_id, status) that it lacks; entries are never refreshed."""
    new = run.groupBy("site", "url").agg(F.min(F.struct("run_id", "status")).alias("x")).select("site", "url", F.col("x.run_id").alias("first_seen"), F.col("x.status").alias("first_status"))
    return tree.unionByName(new.join(tree, ["site", "url"], "left_anti"))


def add_competitors(known: DataFrame, target: str, domains: list[str]) -> DataFrame:
    """known(target, competitor, ordinal) with new domains at the end, each once; www. and case do not tell domains apart."""
    spark = known.sparkSession
    new = spark.createDataFrame(list(enumerate(domains)), "n int, domain string").select("n", site_of(F.col("domain")).alias("competitor")).where("competitor <> ''").groupBy("competitor").agg(F.min("n").alias("n"))
    mine = known.where(F.col("target") == target)
    last = mine.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"))
    fresh = new.join(mine.select("competitor"), "competitor", "left_anti").crossJoin(F.broadcast(last))
    return known.unionByName(fresh.select(F.lit(target).alias("target"), "competitor", (F.col("last") + 1 + F.col("n")).cast("int").alias("ordinal")))
