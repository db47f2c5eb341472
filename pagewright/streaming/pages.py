"""Scoring pages as they land.

Checks that look at a page alone run on the stream unchanged. The site's facts (competing titles, inbound links,
sitemap, languages) come from the last finished run by a stream-static join; without one they are open, and their
checks ask for a review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import normalize_url, site_of, url_hash
from pagewright.operators.extract import snapshot
from pagewright.operators.rules import verdicts
from pagewright.operators.scoring import page_scores
from pagewright.operators.urlsets import merge_url_tree

FACTS = {"competing": "boolean", "inbound_links": "bigint", "in_sitemap": "boolean", "multilingual": "boolean"}


def page_verdicts(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Verdicts of pages(url, html, status), a stream or a table; known(url, competing, inbound_links, in_sitemap, multilingual)."""
    base = pages.withColumns({"site": site_of(F.col("url")), "hash": url_hash(F.col("url"))})
    snap = snapshot(base)
    if known is None:
        snap = snap.withColumns({k: F.lit(None).cast(t) for k, t in FACTS.items()})
    else:
        facts = known.select(normalize_url(F.col("url")).alias("__k"), *FACTS)
        snap = snap.withColumn("__n", normalize_url(F.col("url"))).join(facts, F.col("__n") == F.col("__k"), "left").drop("__n", "__k")
    return verdicts(snap, ["site", "url", "hash"])


def windowed_failures(stream: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Failures by site and check in event-time windows; rows later than the watermark are dropped by Spark."""
    v = stream.withWatermark(time, late)
    return v.where("value = 'FAIL'").groupBy(F.window(time, width), "site", "check_id").agg(F.count("*").alias("n"))


def score_stream(pages: DataFrame, sink: str, checkpoint: str, known: DataFrame | None = None):
    """Starts a query that appends the scores of each micro-batch under sink."""

    def write(batch: DataFrame, n: int) -> None:
        page_scores(page_verdicts(batch, known), ["site", "url"]).write.mode("overwrite").parquet(f"{sink}/batch={n}")  # a retried batch replaces itself

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_stream(pages: DataFrame, sink: str, checkpoint: str):
    """Keeps a first-seen table of URLs: each micro-batch appends those that earlier batches lack."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        schema = "site string, url string, first_seen string, first_status int"
        # one scan whatever the number of batches; a retried batch does not see itself
        known = spark.read.schema(f"{schema}, batch int").parquet(sink).where(F.col("batch") < n).drop("batch") if n else spark.createDataFrame([], schema)
        run = batch.select(site_of(F.col("url")).alias("site"), "url", F.lit(f"{n:06d}").alias("run_id"), "status")
        merge_url_tree(known, run).where(F.col("first_seen") == f"{n:06d}").write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
