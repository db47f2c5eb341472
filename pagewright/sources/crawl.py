"""Breadth-first crawls as generations of frontier tables.

Each generation fetches its frontier, extracts links, and makes the next frontier: links in document order, those on
allowed hosts, not nofollow, not seen, first occurrence each, up to the page limit. Ordinals keep the order a single
queue would have. Generations are written, so that each one is fetched once whatever fails later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.text import body_only
from pagewright.functions.urls import host_of, normalize_url, site_of, url_hash, url_path
from pagewright.operators.extract import links
from pagewright.sources import robots

#: Ordinals of generation d start at d times this.
GENERATION = 1 << 40


@dataclass
class Crawl:
    site: str
    hosts: list[str]
    pages: DataFrame
    disallow: list[str]
    stats: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def inventory(self) -> DataFrame:
        return self.pages.select("url", "final_url", "status", "ok", "depth")

    def status_counts(self) -> DataFrame:
        return self.pages.groupBy("status").agg(F.count("*").alias("n"))


def _one(spark: SparkSession, get: Callable[[DataFrame], DataFrame], url: str):
    return get(spark.createDataFrame([(url,)], "url string")).first()


def _with_answer(get, take: DataFrame, url: str, answer) -> DataFrame:
    """What get gives for take(url, ...), with the answer at hand for one of its URLs, which is not fetched again."""
    rest = get(take.where(F.col("url") != url))
    known = answer.asDict()
    schema = rest.select(*(c for c in rest.columns if c in known and c != "url")).schema
    row = rest.sparkSession.createDataFrame([tuple(known[c] for c in schema.names)], schema)
    return rest.unionByName(take.where(F.col("url") == url).crossJoin(row).select(*rest.columns))  # one row by one


def crawl(spark: SparkSession, seed: str, get: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataFrame], limit: int = 200, depth: int = 2, sitemap_only: bool = False, enforce_robots: bool = False, seed_first: bool = True) -> Crawl:
    """get fetches a table of urls (fetch() or fetch_from_table()); write stores a table under a name and reads it back.

    The queue starts with the URL that the seed leads to, if its host is accepted, and with the answer already fetched;
    then come the sitemap's pages. With seed_first false, as for a local folder, the sitemap's pages come first.
    """
    norm = lambda u: spark.range(1).select(normalize_url(F.lit(u)), host_of(F.lit(u)), site_of(F.lit(u))).first()
    first, host, site = norm(seed)
    answer = _one(spark, get, first)
    final, final_host, _ = norm(answer["final_url"])
    begin = final if final_host == host else first
    hosts, origin, warnings = [host], first.split("/", 3)[:3], []
    if final_host and final_host != host:
        if final_host.removeprefix("www.") == host.removeprefix("www."):
            hosts, begin, origin = [host, final_host], final, answer["final_url"].split("/", 3)[:3]
        else:
            warnings.append(f"{host} answers from {final_host}, which is not crawled")
    origin = "/".join(origin)
    rules = spark.createDataFrame([(_one(spark, get, f"{origin}/robots.txt")["body"],)], "body string").select(robots.parse_robots(F.col("body")).alias("r")).first()["r"]
    roots = rules["sitemaps"] or [f"{origin}/sitemap.xml"]

    def sitemaps(frontier: DataFrame, n: int) -> DataFrame:
        asked = write(frontier, f"sitemaps-asked-{n}")
        bodies = get(asked.select("url")).select("url", F.when(F.col("ok"), F.col("body")).alias("body"))
        return write(asked.join(bodies, "url"), f"sitemaps-{n}")

    listed, counters = robots.expand_sitemaps(spark, sitemaps, roots, hosts)
    start = listed.select(normalize_url(F.col("url")).alias("url"), (F.col("ordinal") + 1).alias("ordinal"))
    if not sitemap_only:
        start = start.unionByName(spark.createDataFrame([(begin, 0 if seed_first else GENERATION - 1)], "url string, ordinal long"))
    frontier = start.where("url <> ''").groupBy("url").agg(F.min("ordinal").alias("ordinal")).withColumn("depth", F.lit(0))
    queued, generations, n, d = None, [], 0, 0
    candidates = frontier.count()
    past_limit = max(0, candidates - limit)
    while n < limit:
        take = write(frontier.orderBy("ordinal").limit(limit - n).select("url", "depth", "ordinal"), f"frontier-{d}")
        count = take.count()
        if not count:
            break
        got = write(_with_answer(get, take, begin, answer) if d == 0 and not sitemap_only else get(take), f"fetched-{d}")
        generations.append(got)
        n += count
        queued = take.select("url") if queued is None else queued.union(take.select("url"))
        if sitemap_only or d >= depth:
            break
        base = F.coalesce("final_url", "url")
        out = got.where("ok").select("ordinal", F.posexplode(links(body_only(F.col("body")), base)).alias("pos", "l"))
        out = out.where(~F.col("l.nofollow")).select("ordinal", "pos", normalize_url(F.col("l.resolved")).alias("url")).where((F.col("url") != "") & host_of(F.col("url")).isin(hosts))
        if enforce_robots:
            out = out.where(robots.allowed(url_path(F.col("url")), F.array(*map(F.lit, rules["disallow"])) if rules["disallow"] else F.array().cast("array<string>")))
        new = out.join(queued, "url", "left_anti").groupBy("url").agg(F.min(F.struct("ordinal", "pos")).alias("o"))
        d += 1
        # a generation is at most `limit` rows once it is cut, so one window orders it
        frontier = new.orderBy("o").limit(limit - n).select("url", F.lit(d).alias("depth"), (F.row_number().over(Window.orderBy("o")) + F.lit(d * GENERATION)).cast("long").alias("ordinal"))
    pages = generations[0]
    for g in generations[1:]:
        pages = pages.unionByName(g)
    pages = pages.withColumns({"site": F.lit(site), "hash": url_hash(F.col("url"))}).withColumnRenamed("body", "html")
    failed = pages.where("not ok").count()
    stats = {"candidates": n + past_limit, "fetched": n, "failed": failed, "seed_final_url": answer["final_url"], "redirected_seed": bool(answer["redirected"] or (final_host and final_host != host)), "hosts": hosts, "sitemaps": counters["sitemaps"], "sitemap_indexes": counters["indexes"], "sitemap_entries": counters["entries"], "generations": len(generations)}
    return Crawl(site, hosts, pages, list(rules["disallow"]), stats, warnings)
