"""Runs as a stream: what has been committed to a store, each run once, and the latest run of each site.

A run counts when its commit marker is there, a file of one JSON row that the store writes after the run's data. The
stream reads markers. A marker that is written again, as retried jobs do, is dropped while the watermark still
holds the first one; event time is the time that the run's stamp names. New runs are handed on, all of a batch as one
table; the greatest stamp of each site goes to a table of its own, so the latest run needs no listing of folders.

Defined results: markers out of order change nothing, as the latest run is the greatest stamp; a marker older than the
watermark is too late to be handed on, and cannot be the latest run of a site that has a later one; a stamp that
names no time, or a marker without site or run_id, is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "site string, run_id string, rows long"
LATEST = "site string, run_id string, runs long"


def stamp_time(run_id="run_id"):
    """The time, to the second, that a stamp names."""
    return F.try_to_timestamp(F.substring(run_id, 1, 19), F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def new_runs(commits: DataFrame, late: str) -> DataFrame:
    """commits(site, run_id) with each run once, from a stream of markers in any order."""
    timed = commits.withColumn("ts", stamp_time()).where("ts is not null and site is not null")
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["site", "run_id"])


def markers(spark: SparkSession, root: str, kind: str, at_once: int) -> DataFrame:
    return spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", at_once).json(f"{root.rstrip('/')}/commits/{kind}")


def run_stream(spark: SparkSession, root: str, kind: str, checkpoint: str, each: Callable[[DataFrame, int], None], late: str = "30 days", at_once: int = 200):
    """Starts a query that calls each(rows of a batch's new runs, batch number) until all markers at hand are done.

    A batch that is run again is handed on again under its number, so what each() writes should go by that number.
    """
    base = f"{root.rstrip('/')}/{kind}"

    def hand_on(batch: DataFrame, n: int) -> None:
        runs = batch.select("site", "run_id").collect()  # as many as markers at once
        if runs:
            paths = sorted(f"{base}/site={r['site']}/run_id={r['run_id']}" for r in runs)
            # stamps and sites look like dates and numbers at times, but are text
            rows = spark.read.option("basePath", base).parquet(*paths)
            each(rows.withColumns({k: F.col(k).cast("string") for k in ("site", "run_id")}), n)

    return new_runs(markers(spark, root, kind, at_once), late).writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(spark: SparkSession, root: str, kind: str, sink: str, checkpoint: str, late: str = "30 days", at_once: int = 200):
    """Starts a query that keeps the greatest stamp and the number of runs of each site, a small table a batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.groupBy("site").agg(F.max("run_id").alias("run_id"), F.count("*").alias("runs")).write.mode("overwrite").parquet(f"{sink}/batch-{n:06d}")

    return new_runs(markers(spark, root, kind, at_once), late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_runs(spark: SparkSession, sink: str) -> DataFrame:
    """site, run_id and runs, from what latest_stream() has written."""
    return spark.read.schema(LATEST).parquet(f"{sink}/batch-*").groupBy("site").agg(F.max("run_id").alias("run_id"), F.sum("runs").alias("runs"))
