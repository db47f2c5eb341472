"""Crawls of many sites as one stream: the frontier is the state of its site.

The stream reads events, which are seeds and answers. For each site the state holds the set of URLs seen, the queue by
place, what is in flight, and when the site may be asked again. It hands out the queue in waves: once all answers of a
wave are there, their links join the queue in document order, first occurrence each, up to the page limit; so places
equal those of one queue that takes a page at a time. A timer starts the next wave after the pause. A batch's requests are fetched and parsed
by Spark, and the links found go back into the events folder, from which the next batch reads.

Every step of a batch is a folder that is written once. A batch that is run again, after a crash or by a restart from the
checkpoint, reads what is there; so nothing is fetched twice but what was in flight when the driver died.

Defined results: a seed listed twice counts once; null and invalid URLs of seeds are left out; seeds beyond the limit
stay in the queue; an answer that comes twice counts once; a site whose queue is empty, or whose limit is reached, is done.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagewright.functions.text import body_only
from pagewright.functions.urls import host_of, normalize_url, url_hash
from pagewright.operators.extract import links

EVENT = "site string, kind string, url string, ordinal long, depth int, ok boolean, links array<string>, hosts array<string>"
REQUEST = "site string, kind string, url string, depth int, ordinal long, hosts array<string>"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Frontier(StatefulProcessor):
    """Events of one site in, its requests out. Waves have at most `wave` URLs; `pause` is in seconds for each of them."""

    def __init__(self, limit: int, depth: int, wave: int, pause: float):
        self.limit, self.depth, self.wave, self.pause = limit, depth, wave, pause

    def init(self, handle) -> None:
        self.handle = handle
        # queued: places given so far; asked: places handed out; due: when the next wave may start, in ms
        self.numbers = handle.getValueState("numbers", "queued long, asked long, due long")
        self.hosts = handle.getValueState("hosts", "hosts array<string>")
        self.seen = handle.getMapState("seen", "url string", "place long")
        self.queue = handle.getMapState("queue", "place long", "url string, depth int")
        self.flying = handle.getMapState("flying", "url string", "place long")
        self.landed = handle.getListState("landed", "ordinal long, depth int, links array<string>")

    def _add(self, n: dict, url: str, depth: int) -> None:
        if not self.seen.containsKey((url,)):
            self.seen.updateValue((url,), (n["queued"],))
            self.queue.updateValue((n["queued"],), (url, depth))
            n["queued"] += 1

    def handleInputRows(self, key, rows, timerValues):
        n = self.numbers.get()
        n = {"queued": n[0], "asked": n[1], "due": n[2]} if n else {"queued": 0, "asked": 0, "due": 0}
        seeds, answers = [], []
        for r in rows:
            (seeds if r["kind"] == "seed" else answers).append(r)
        for r in sorted(seeds, key=lambda r: (r["ordinal"], r["url"])):
            if not self.hosts.exists():
                self.hosts.update((list(r["hosts"] or []),))
            self._add(n, r["url"], 0)
        for r in answers:
            if self.flying.containsKey((r["url"],)):
                self.flying.removeKey((r["url"],))
                if r["ok"] and r["depth"] < self.depth and r["links"]:
                    self.landed.appendValue((r["ordinal"], r["depth"], list(r["links"])))
        yield from self._go_on(key, n, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n = self.numbers.get()
        yield from self._go_on(key, {"queued": n[0], "asked": n[1], "due": n[2]}, timerValues)

    def _go_on(self, key, n: dict, timerValues):
        if next(self.flying.keys(), None) is None:
            for _, depth, found in sorted((tuple(x) for x in self.landed.get()), key=lambda x: x[0]):
                for url in dict.fromkeys(found):
                    if n["queued"] < self.limit:
                        self._add(n, url, depth + 1)
            self.landed.clear()
            now = timerValues.getCurrentProcessingTimeInMs()
            stop = min(n["queued"], self.limit, n["asked"] + self.wave)
            if n["asked"] >= stop:
                yield Row(site=key[0], kind="done", url=None, depth=None, ordinal=None, hosts=None)
            elif now < n["due"]:
                self.handle.registerTimer(n["due"])
            else:
                hosts = list(self.hosts.get()[0])
                for place in range(n["asked"], stop):
                    url, depth = self.queue.getValue((place,))
                    self.queue.removeKey((place,))
                    self.flying.updateValue((url,), (place,))
                    yield Row(site=key[0], kind="ask", url=url, depth=depth, ordinal=place, hosts=hosts)
                n["due"] = now + round(1000 * self.pause * (stop - n["asked"]))
                n["asked"] = stop
        self.numbers.update((n["queued"], n["asked"], n["due"]))

    def close(self) -> None:
        pass


class FrontierStream:
    """A crawl stream below `folder`, which the driver and all executors share. get answers a table of urls, as in crawl()."""

    def __init__(self, spark: SparkSession, folder: str, get: Callable[[DataFrame], DataFrame], limit: int = 200, depth: int = 2, wave: int = 50, pause: float = 0.0):
        self.spark, self.folder, self.get = spark, folder.rstrip("/"), get
        self.processor = Frontier(limit, depth, wave, pause)

    def _there(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _once(self, df: DataFrame, name: str) -> DataFrame:
        if not self._there(name):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def seed(self, seeds: DataFrame, name: str = "seeds") -> None:
        """Starts sites: seeds(site, url, ordinal, hosts); hosts are those that the site's crawl may follow."""
        rows = seeds.select("site", F.lit("seed").alias("kind"), normalize_url(F.col("url")).alias("url"), F.col("ordinal").cast("long"), F.lit(0).alias("depth"), F.lit(None).cast("boolean").alias("ok"), F.array().cast("array<string>").alias("links"), "hosts")
        self._once(rows.where("url <> ''"), f"events/{name}")

    def _batch(self, batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            # every partition is read, also of a batch that is run again: that is what moves the state on
            if not batch.count() and not self._there(f"requests/{n:06d}"):
                return
            asked = self._once(batch, f"requests/{n:06d}").where("kind = 'ask'").drop("kind")
        finally:
            batch.unpersist()
        if not asked.isEmpty():
            with ThreadPoolExecutor(1) as own:  # a thread of its own, since parsing has deep plans and the stream's stack is in use
                own.submit(self._answer, asked, n).result()

    def _answer(self, asked: DataFrame, n: int) -> None:
        got = self.get(asked.select("url").distinct())
        pages = self._once(asked.join(got, "url"), f"pages/{n:06d}")
        base = F.coalesce("final_url", "url")
        found = pages.where("ok").select("site", "ordinal", "hosts", F.posexplode(links(body_only(F.col("body")), base)).alias("pos", "l")).where(~F.col("l.nofollow"))
        found = found.select("site", "ordinal", "hosts", "pos", normalize_url(F.col("l.resolved")).alias("to")).where((F.col("to") != "") & F.array_contains("hosts", host_of(F.col("to"))))
        lists = found.groupBy("site", "ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]).alias("links"))  # of one page
        answers = pages.select("site", "url", "ordinal", "depth", "ok").join(lists, ["site", "ordinal"], "left")
        self._once(answers.select("site", F.lit("answer").alias("kind"), "url", "ordinal", "depth", "ok", "links", F.lit(None).cast("array<string>").alias("hosts")), f"events/{n:06d}")

    def start(self, every: str = "1 second"):
        """The running query. State is kept by RocksDB, which the query takes from the session as it starts."""
        events = self.spark.readStream.schema(EVENT).parquet(f"{self.folder}/events/*")
        requests = events.groupBy("site").transformWithState(self.processor, REQUEST, "Append", "ProcessingTime")
        before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, ROCKS)
        try:
            return requests.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=every).start()
        finally:
            self.spark.conf.set(STORE, before)

    def _read(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/*")

    def unfinished(self) -> int:
        """Sites that have been seeded and are not done."""
        seeded = self._read("events", EVENT).where("kind = 'seed'").select("site").distinct()
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/requests")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return seeded.count()
        return seeded.join(self._read("requests", REQUEST).where("kind = 'done'").select("site").distinct(), "site", "left_anti").count()

    def run(self, timeout: float = 3600.0) -> DataFrame:
        """Runs until every seeded site is done, and gives the pages."""
        query, end, seen = self.start(), time.monotonic() + timeout, -1
        try:
            while time.monotonic() < end:
                if query.exception():
                    raise query.exception()
                at = (query.lastProgress or {"batchId": -1})["batchId"]
                if at != seen and not self.unfinished():
                    return self.pages()
                seen = at
                time.sleep(0.2)
            raise TimeoutError(f"sites are not done after {timeout} s")
        finally:
            while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:  # not in the middle of a batch
                time.sleep(0.02)
            query.stop()

    def pages(self) -> DataFrame:
        """Pages with site, url, depth, ordinal (its place in the site's queue) and what was fetched."""
        pages = self.spark.read.parquet(f"{self.folder}/pages/*")
        return pages.drop("hosts").withColumnRenamed("body", "html").withColumn("hash", url_hash(F.col("url")))
