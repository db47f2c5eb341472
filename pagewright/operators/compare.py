"""Fail rates of a target site against those of competitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.checks import checks_table

LEAST_PAGES = 10
DELTA = 0.1


def fail_rates(verdicts: DataFrame) -> DataFrame:
    """site, check_id, rate (failed of all verdicts; 0 for checks without any) and pages of the site."""
    dim = F.broadcast(checks_table(verdicts.sparkSession).select("check_id"))
    sites = verdicts.groupBy("site").agg(F.count_distinct("url").alias("pages"))
    rates = verdicts.groupBy("site", "check_id").agg((F.count_if(F.col("value") == "FAIL").cast("double") / F.count("*")).alias("rate"))
    return sites.crossJoin(dim).join(rates, ["site", "check_id"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def compare_sites(rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (target, competitor) of pairs and each check: both rates, delta, and confidence (low under 10 pages)."""
    t = rates.select(F.col("site").alias("target"), "check_id", F.col("rate").alias("target_rate"), F.col("pages").alias("tp"))
    k = rates.select(F.col("site").alias("competitor"), "check_id", F.col("rate").alias("competitor_rate"), F.col("pages").alias("cp"))
    j = pairs.join(t, "target").join(k, ["competitor", "check_id"])
    low = (F.col("tp") < LEAST_PAGES) | (F.col("cp") < LEAST_PAGES)
    return j.select("target", "competitor", "check_id", "target_rate", "competitor_rate", (F.col("target_rate") - F.col("competitor_rate")).alias("delta"), F.when(low, "low").otherwise("normal").alias("confidence"))


def worse(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("delta") >= F.lit(DELTA))


def better(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("delta") <= F.lit(-DELTA))


def warnings(compared: DataFrame) -> DataFrame:
    """(target, competitor) pairs that rest on few pages."""
    return compared.where("confidence = 'low'").select("target", "competitor").distinct()


def report_areas(matrix: DataFrame, k: int = 15) -> DataFrame:
    """The k checks with the highest fail rate of all applicable pages; ties by failures, then by the order of checks."""
    dim = F.broadcast(checks_table(matrix.sparkSession).select("check_id", "title", "severity", "gap_category"))
    seen = F.col("pass") + F.col("fail") + F.col("needs_review")
    rate = F.when(seen > 0, F.col("fail").cast("double") / seen).otherwise(0.0)
    rows = matrix.where((F.col("fail") > 0) | (F.col("needs_review") > 0)).withColumn("fail_rate", rate).join(dim, "check_id")
    return rows.orderBy(F.desc("fail_rate"), F.desc("fail"), "check_id").limit(k)
