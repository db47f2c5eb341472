"""Site-wide checks on a stream of pages, with corrections of what was said before.

Three checks depend on other pages: whether another page competes for the same title (C003), whether any page links here (C004), and
whether a page of a site with several languages names its versions (C034). Each page is told at once what holds so far;
when a later page changes that, the earlier pages get a correction. State is kept by what pages meet in, not by site:
(site, title and heading) holds one URL until a second one comes; (site, link target) holds the URLs that wait for a
first link; the languages of a site are at most two codes, then a flag.

A value only ever moves one way (C003 to FAIL, C004 to PASS, C034 from N/A to FAIL), so settled() takes the furthest one
of each URL, whatever the order of the batches and however often one is run again. A correction for all pages of a site is
one row without a URL.

Defined results: pages that share a URL are one page; a page without title and heading competes with none; a null url or
html is an empty one; pages without a site form a site of their own; a page that links to itself is linked to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagewright.functions.urls import is_absolute, normalize_url, site_of, url_path
from pagewright.operators.context import LANGUAGE, signature
from pagewright.operators.extract import snapshot
from pagewright.streaming.frontier import ROCKS, STORE

EVENT = "array<struct<scope:string,key:string,kind:string>>"
CORRECTION = "site string, url string, check_id string, value string"
#: The values of each check from first to last.
COURSE = {"C003": ("PASS", "FAIL"), "C004": ("FAIL", "PASS"), "C034": ("N/A", "PASS", "FAIL")}


def page_events(pages: DataFrame) -> DataFrame:
    """site, url, scope, key and kind: what each of pages(url, html) tells of its site."""
    base = pages.select(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    snap = snapshot(base.withColumns({"site": site_of(F.col("url")), "status": F.lit(200), "hash": F.lit("")}))
    snap = snap.select("site", "url", normalize_url(F.col("url")).alias("own"), signature().alias("title"), F.array_distinct(F.transform("links", lambda x: x["resolved"])).alias("to"), (F.size("hreflang") > 0).alias("declared"))
    said = lambda scope, key, kind: F.struct(F.lit(scope).alias("scope"), key.alias("key"), F.lit(kind).alias("kind"))
    first = lambda u: F.lower(F.get(F.filter(F.split(url_path(u), "/"), lambda x: x != ""), F.lit(0)))
    codes = F.array_distinct(F.transform(F.filter("to", is_absolute), first))
    events = F.concat(
        F.array(said("title", F.coalesce("title", F.lit("")), "page"), said("target", F.col("own"), "page"), said("language", F.lit(""), "page")),
        F.transform(F.array_distinct(F.transform("to", normalize_url)), lambda u: said("target", u, "link")),
        F.transform(F.filter(codes, lambda x: x.rlike(LANGUAGE)), lambda x: F.struct(F.lit("language").alias("scope"), F.lit("").alias("key"), F.concat(F.lit("code:"), x).alias("kind"))),
        F.when(F.col("declared"), F.array(said("language", F.lit(""), "declared"))).otherwise(F.array().cast(EVENT)),
    )
    return snap.select("site", "url", "declared", F.explode(events).alias("e")).select("site", "url", "declared", "e.scope", "e.key", "e.kind").where("kind <> 'link' or key <> ''")


class SiteChecks(StatefulProcessor):
    """Events of one (site, scope, key) in, verdicts and corrections out."""

    def init(self, handle) -> None:
        self.url = handle.getValueState("url", "url string")  # title: the one URL so far
        self.settled = handle.getValueState("settled", "yes boolean")
        self.waiting = handle.getMapState("waiting", "url string", "there boolean")
        self.codes = handle.getMapState("codes", "code string", "there boolean")

    def handleInputRows(self, key, rows, timerValues):
        site, scope, of = key
        yield from getattr(self, scope)(site, of, rows)

    def title(self, site, of, rows):
        for url in dict.fromkeys(r["url"] for r in rows):
            first = self.url.get()
            if of == "" or first is None or first[0] == url and not self.settled.exists():
                if of != "" and first is None:
                    self.url.update((url,))
                yield Row(site=site, url=url, check_id="C003", value="PASS")
                continue
            if not self.settled.exists():
                self.settled.update((True,))
                yield Row(site=site, url=first[0], check_id="C003", value="FAIL")
            yield Row(site=site, url=url, check_id="C003", value="FAIL")

    def target(self, site, of, rows):
        linked = self.settled.exists()
        pages: dict[str, None] = {}
        for r in rows:
            if r["kind"] == "page":
                pages[r["url"]] = None
            elif not linked:
                linked = True
                self.settled.update((True,))
        if linked:
            for (url,) in list(self.waiting.keys()):
                pages[url] = None
                self.waiting.removeKey((url,))
        for url in pages:
            if not linked:
                self.waiting.updateValue((url,), (True,))
            yield Row(site=site, url=url, check_id="C004", value="PASS" if linked else "FAIL")

    def language(self, site, of, rows):
        several, known = self.settled.exists(), {k[0] for k in self.codes.keys()}
        for r in rows:
            if r["kind"] == "page":
                yield Row(site=site, url=r["url"], check_id="C034", value="PASS" if r["declared"] else "N/A")
            elif not several:
                code = r["kind"].removeprefix("code:")
                if r["kind"] != "declared" and code not in known:
                    known.add(code)
                    self.codes.updateValue((code,), (True,))
                if r["kind"] == "declared" or len(known) > 1:
                    several = True
                    self.settled.update((True,))
                    self.codes.clear()
                    yield Row(site=site, url=None, check_id="C034", value="FAIL")

    def close(self) -> None:
        pass


def corrections(pages: DataFrame) -> DataFrame:
    """site, url, check_id and value as they become known, from a stream of pages(url, html)."""
    return page_events(pages).groupBy("site", "scope", "key").transformWithState(SiteChecks(), CORRECTION, "Append", "None")


def site_checks_stream(pages: DataFrame, sink: str, checkpoint: str):
    """Starts a query that appends corrections below sink until the pages at hand are done."""
    spark = pages.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch-{n:06d}")  # a retried batch replaces itself

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return corrections(pages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def settled(said: DataFrame) -> DataFrame:
    """site, url, check_id and value after all corrections so far; said: the rows that the stream has written."""
    place = F.create_map(*(F.lit(x) for check, values in COURSE.items() for k, v in enumerate(values) for x in (f"{check} {v}", k)))
    ranked = said.withColumn("place", place[F.concat_ws(" ", "check_id", "value")])
    page = ranked.where("url is not null").groupBy("site", "url", "check_id").agg(F.max_by("value", "place").alias("value"))
    site = ranked.where("url is null").select(F.col("site").alias("s"), F.col("check_id").alias("c"), F.col("value").alias("whole")).distinct()  # a row for each site at most
    j = page.join(site, page["site"].eqNullSafe(site["s"]) & (page["check_id"] == site["c"]), "left")
    return j.select("site", "url", "check_id", F.when(F.col("value") == "N/A", F.coalesce("whole", "value")).otherwise(F.col("value")).alias("value"))
