"""Fetching that is polite to every host and waits for none: a Python data source.

URLs are dealt into groups by host, and a group is a partition of the source. Its reader keeps the hosts in a heap by the
time when each may be asked next. A host has one request at a time and a pause after its answer; meanwhile other hosts
are asked, several at once. So a group takes about as long as its busiest host, not as long as all of them together.

    polite_fetch(urls, fetcher="pagewright.sources.fetch:http_fetcher", pause=0.25)

The list of URLs is a table, not an option, so its length is bounded by nothing; a reader holds `hold` of them at once,
in an order that mixes hosts. A fetcher is named as module:function; the function makes a callable
url -> (status, final_url, content_type, body). `replay` answers from recorded columns of the list itself instead, in
virtual time, which tests a schedule or replays an archive without waiting.

Defined results: a URL is asked once however often it is listed; a null URL is left out; a URL without a host is asked
under the empty host; whatever a fetcher raises is a row with status 0, or with the exception's code, and the error.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewright.functions.urls import host_of
from pagewright.sources.scratch import Folder

FETCHED = "url string, final_url string, redirected boolean, status int, ok boolean, content_type string, body string, error string"
LISTED = ["host", "url"]
RECORDED = ["status", "final_url", "content_type", "body"]
REPLAY = "replay"


def answer(url: str, ask: Callable[[], tuple]) -> tuple:
    """A row of FETCHED from what ask() gives or raises."""
    try:
        status, final, kind, body = ask()
        return url, final, final != url, status, 200 <= status < 300, kind, body, None
    except Exception as e:  # what servers do is data
        return url, url, False, int(getattr(e, "code", 0) or 0), False, "", "", f"{type(e).__name__}: {e}"


class Threads:
    """Requests in flight on threads, in real time."""

    def __init__(self, most: int):
        self.most, self.pool, self.running = most, ThreadPoolExecutor(most), {}

    def now(self) -> float:
        return time.monotonic()

    def full(self) -> bool:
        return len(self.running) >= self.most

    def start(self, key, ask: Callable[[], tuple]) -> None:
        self.running[self.pool.submit(ask)] = key

    def landed(self, until: float | None) -> list[tuple]:
        """(key, result) of what lands first, or nothing at the time `until`."""
        rest = None if until is None else max(0.0, until - self.now())
        if not self.running:
            time.sleep(rest or 0.0)
            return []
        done: set[Future] = wait(self.running, rest, FIRST_COMPLETED).done
        return [(self.running.pop(f), f.result()) for f in done]

    def close(self) -> None:
        self.pool.shutdown(cancel_futures=True)


class Virtual:
    """Requests in virtual time: waiting moves the clock, and a request takes as long as `takes` says of its key."""

    def __init__(self, most: int, takes: Callable[[tuple], float] = lambda key: 0.0):
        self.most, self.takes, self.time, self.running, self.n = most, takes, 0.0, [], 0

    def now(self) -> float:
        return self.time

    def full(self) -> bool:
        return len(self.running) >= self.most

    def start(self, key, ask: Callable[[], tuple]) -> None:
        self.n += 1
        heapq.heappush(self.running, (self.time + self.takes(key), self.n, key, ask))

    def landed(self, until: float | None) -> list[tuple]:
        if self.running and (until is None or self.running[0][0] <= until):
            self.time, _, key, ask = heapq.heappop(self.running)
            return [(key, ask())]
        self.time = max(self.time, until or 0.0)
        return []

    def close(self) -> None:
        self.running = []


def in_turn(listed: Iterable[tuple[str, str, Callable[[], tuple]]], flights: Threads | Virtual, pause: float, hold: int = 10_000) -> Iterator[tuple[float, tuple]]:
    """(when it was asked, result) for each of listed(host, url, ask), in the order of their answers."""
    source, begun = iter(listed), flights.now()
    waiting: dict[str, deque] = {}
    ready: list[tuple[float, int, str]] = []  # hosts that may be asked, by time and then by turn
    busy: set[str] = set()
    n = turn = 0
    more = True
    try:
        while True:
            while more and n < hold:
                item = next(source, None)
                if item is None:
                    more = False
                    break
                host, url, ask = item
                if host not in waiting:
                    waiting[host] = deque()
                    turn += 1
                    heapq.heappush(ready, (flights.now(), turn, host))
                waiting[host].append((url, ask))
                n += 1
            while ready and not flights.full() and ready[0][0] <= flights.now():
                host = heapq.heappop(ready)[2]
                if not waiting[host]:  # nothing came for it during its pause
                    del waiting[host]
                    continue
                _, ask = waiting[host].popleft()
                n -= 1
                busy.add(host)
                flights.start((host, flights.now() - begun), ask)
            if not busy and not ready:
                if not more:
                    return
                continue
            until = ready[0][0] if ready and not flights.full() else None
            for (host, asked), result in flights.landed(until):
                busy.discard(host)
                turn += 1
                heapq.heappush(ready, (flights.now() + pause, turn, host))
                yield asked, result
    finally:
        flights.close()


@dataclass
class Group(InputPartition):
    path: str


class PoliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fetcher = options["path"].rstrip("/"), options.get("fetcher", "pagewright.sources.fetch:http_fetcher")
        self.pause, self.flights, self.hold = float(options.get("pause", 0.25)), int(options.get("flights", 16)), int(options.get("hold", 10_000))

    def partitions(self) -> list[Group]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        return [Group(f"{self.path}/{f.base_name}") for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("group=")]

    def read(self, partition: Group) -> Iterator[tuple]:
        from pyarrow import dataset, fs

        if partition is None or partition.path is None:
            return
        store, root = fs.FileSystem.from_uri(partition.path)
        rows = (r for b in dataset.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=256) for r in b.to_pylist())
        replay = self.fetcher == REPLAY
        fetch = None
        if not replay:
            module, name = self.fetcher.split(":")
            fetch = getattr(import_module(module), name)()

        def asking(r: dict) -> Callable[[], tuple]:
            if replay:
                return lambda: answer(r["url"], lambda: tuple(r[c] for c in RECORDED))
            return lambda: answer(r["url"], lambda: fetch(r["url"]))

        listed = ((r["host"], r["url"], asking(r)) for r in rows)
        for asked, row in in_turn(listed, Virtual(self.flights) if replay else Threads(self.flights), self.pause, self.hold):
            yield (*row, asked)


class PoliteSource(DataSource):
    """Options: path (a list of URLs in folders group=<n>), fetcher, pause, flights (at once, in a group) and hold."""

    @classmethod
    def name(cls) -> str:
        return "polite"

    def schema(self) -> str:
        return f"{FETCHED}, asked double"

    def reader(self, schema) -> PoliteReader:
        return PoliteReader(self.options)


def write_list(urls: DataFrame, path: str, groups: int) -> None:
    """urls(url), and its recorded columns if it has any, by group of hosts; within a group the hosts are mixed."""
    recorded = [c for c in RECORDED if c in urls.columns]
    once = urls.where("url is not null").select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "url", *recorded).dropDuplicates(["url"])
    grouped = once.withColumn("group", F.pmod(F.xxhash64("host"), F.lit(groups)).cast("int"))
    grouped.repartition(groups, "group").sortWithinPartitions("group", F.sha1("url")).write.partitionBy("group").parquet(path)


def polite_fetch(urls: DataFrame, fetcher: str = "pagewright.sources.fetch:http_fetcher", pause: float = 0.25, flights: int = 16, groups: int | None = None, hold: int = 10_000) -> DataFrame:
    """The answers for urls(url), as fetch_from_table() gives them, and asked, the seconds into its group at which each was asked."""
    spark = urls.sparkSession
    path = f"{Folder(spark, 'polite').path}/urls"
    write_list(urls, path, groups or max(1, spark.sparkContext.defaultParallelism))
    spark.dataSource.register(PoliteSource)
    return spark.read.format("polite").options(path=path, fetcher=fetcher, pause=pause, flights=flights, hold=hold).load()
