"""The audit of a page table, end to end: snapshots, site context, verdicts.

Snapshots and wide verdicts are written once to the shared folder and read again: the first feed several joins, the
second feed every aggregate, and neither regex work nor lineage is repeated.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import site_of, url_hash
from pagewright.operators.checks import CHECKS, check_id
from pagewright.operators.context import with_context
from pagewright.operators.extract import snapshot
from pagewright.operators.rules import wide_verdicts
from pagewright.operators.scoring import check_matrix, page_scores
from pagewright.sources.scratch import Folder


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with site and hash, and the crawl facts that a page table lacks as constants."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.withColumns({"site": site_of(F.col("url")), "hash": url_hash(F.col("url")), "status": F.lit(200), "ok": F.lit(True), "depth": F.lit(0)})


class Audit:
    def __init__(self, pages: DataFrame):
        self.spark, self.pages = pages.sparkSession, pages
        self.folder = Folder(self.spark, "audit")
        self.written, self.clean = self.folder.written, self.folder.clean

    @cached_property
    def snapshots(self) -> DataFrame:
        # pages are CPU-heavy for their bytes, so they are spread before extraction
        n = self.spark.sparkContext.defaultParallelism
        spread = self.pages.repartition(n) if self.pages.rdd.getNumPartitions() < n else self.pages
        return self.written(snapshot(spread).drop("html"), "snapshots")

    @cached_property
    def wide(self) -> DataFrame:
        """page_id, site, url, hash and one column for each check."""
        return self.written(wide_verdicts(with_context(self.snapshots), ["page_id", "site", "url", "hash"]), "verdicts")

    @cached_property
    def verdicts(self) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(check_id(n)).alias("check_id"), F.col(check_id(n)).alias("value")) for n, *_ in CHECKS))).alias("v")
        return self.wide.select("page_id", "site", "url", "hash", rows).select("page_id", "site", "url", "hash", "v.check_id", "v.value")

    @cached_property
    def scores(self) -> DataFrame:
        return page_scores(self.verdicts, ["site", "page_id", "url"])

    @cached_property
    def matrix(self) -> DataFrame:
        return check_matrix(self.verdicts, ["site"])


_audits: dict[tuple[str, str], Audit] = {}


def audit(spark: SparkSession, sf_dir: str) -> Audit:
    """One audit for each session and page table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _audits:
        _audits[key] = Audit(page_table(spark, sf_dir))
    return _audits[key]
