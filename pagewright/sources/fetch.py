"""Page fetching: over HTTP, or from a folder that stands for a site. Fetchers never raise; a failure is a row.

A fetcher is a picklable callable: url -> (status, final_url, content_type, body). It runs on executors. A host's URLs
lie in one task, which asks a host for one page at a time with a pause after each answer, and other hosts meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import host_of
from pagewright.sources.polite import FETCHED, Threads, answer, in_turn

Fetcher = Callable[[str], tuple]
LOCAL_ORIGIN = "https://local.site"
AGENT = "pagewright/0.1"


#: A body beyond this many bytes is an error, so that no answer fills a task's memory.
MOST_BYTES = 64 << 20


def http_fetcher(timeout: float = 15.0, most: int = MOST_BYTES) -> Fetcher:
    def fetch(url: str) -> tuple:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml,*/*"}), timeout=timeout) as r:
            body = r.read(most + 1)
            if len(body) > most:
                raise ValueError(f"more than {most} bytes")
            return r.status, r.url, r.headers.get("Content-Type", ""), body.decode(r.headers.get_content_charset() or "utf-8", "replace")

    return fetch


def is_local_seed(seed: str) -> bool:
    """file:// URLs and whatever is not http(s) name a folder."""
    return not seed.lower().startswith(("http://", "https://"))


def local_name(url: str) -> str:
    """The file of a virtual URL: / is index.html, and a path without a suffix is an .html file."""
    path = urlsplit(url).path
    if path.endswith("/") or not path:
        path += "index.html"
    return (path if PurePosixPath(path).suffix else path + ".html").lstrip("/")


def folder_pages(spark: SparkSession, folder: str) -> DataFrame:
    """name and body of the files of a site folder, read by Spark, so any store that Spark reaches will do."""
    root = folder if "://" in folder else f"file://{folder}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,txt,xml}").load(root)
    base = df.select("path").first()
    prefix = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    plain = "/" + root.split("://", 1)[1].strip("/") + "/"
    return df.select(F.substring(prefix, F.lit(len(plain) + 1), F.length(prefix)).alias("name"), F.decode("content", "UTF-8").alias("body")) if base else spark.createDataFrame([], "name string, body string")


def local_site(files: DataFrame) -> DataFrame:
    """url, status, final_url and body of a folder's files(name, body), under virtual URLs: also without .html, and folders for their index.html."""
    name = F.col("name")
    plain = F.regexp_replace(name, r"\.html$", "")
    alias = F.when(plain.rlike("(^|/)index$"), F.regexp_replace(plain, "index$", "")).otherwise(plain)
    names = files.select("body", F.explode(F.when(name.endswith(".html"), F.array(name, alias)).otherwise(F.array(name))).alias("at"))
    url = F.concat(F.lit(LOCAL_ORIGIN + "/"), "at")
    return names.select(url.alias("url"), F.lit(200).alias("status"), url.alias("final_url"), "body")


def fetch_from_table(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Fetches urls(url) from pages(url, status, final_url, body), an archive or a folder: a join. Missing pages are 404."""
    p = pages.select(F.col("url").alias("__u"), F.col("status").alias("__s"), F.col("final_url").alias("__f"), F.col("body").alias("__b"))
    j = urls.join(p, F.col("url") == F.col("__u"), "left")
    status, final = F.coalesce("__s", F.lit(404)), F.coalesce("__f", "url")
    return j.select(*urls.columns, final.alias("final_url"), (final != F.col("url")).alias("redirected"), status.cast("int").alias("status"), status.between(200, 299).alias("ok"), F.lit("text/html").alias("content_type"), F.coalesce("__b", F.lit("")).alias("body"), F.lit(None).cast("string").alias("error"))


def fetch(urls: DataFrame, fetcher: Fetcher, pause: float = 0.25, tasks: int | None = None, flights: int = 16) -> DataFrame:
    """Fetches urls(url) on the executors, `flights` at once in a task. A status of 0 tells a failure, with the error beside it."""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        asking = lambda u: lambda: answer(u, lambda: fetcher(u))
        listed = ((h or "", u, asking(u)) for pdf in parts for h, u in zip(pdf["host"], pdf["url"], strict=True))
        for _, row in in_turn(listed, Threads(flights), pause):
            yield pd.DataFrame([row], columns=["url", "final_url", "redirected", "status", "ok", "content_type", "body", "error"])

    n = tasks or urls.sparkSession.sparkContext.defaultParallelism
    # hosts are mixed within a task, so that few of them wait at once
    return urls.select(host_of(F.col("url")).alias("host"), "url").repartition(n, "host").sortWithinPartitions(F.xxhash64("url")).mapInPandas(run, FETCHED)
