"""Page scores, buckets, the check matrix and site summaries over verdicts(site, url, check_id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import round_half_up
from pagewright.operators.checks import NEEDS_REVIEW_PENALTY, checks_table

BUCKETS = [("high", 95.0), ("average", 90.0), ("low", 80.0), ("bad", 60.0), ("very_bad", None)]


def score_bucket(score: Column) -> Column:
    out = None
    for name, least in BUCKETS[:-1]:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(BUCKETS[-1][0])


def page_scores(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score and bucket: 100 less the weights of failed checks and half a point for each review."""
    dim = F.broadcast(checks_table(verdicts.sparkSession).select("check_id", "weight"))
    lost = F.sum(F.when(F.col("value") == "FAIL", F.col("weight")).otherwise(0.0)) + NEEDS_REVIEW_PENALTY * F.count_if(F.col("value") == "NEEDS_REVIEW")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_half_up((100.0 - lost) * 100) / 100))
    return verdicts.join(dim, "check_id").groupBy(*keys).agg(score.alias("score")).withColumn("bucket", score_bucket(F.col("score")))


def bucket_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, bucket, pages: every bucket for every group, also where it is empty."""
    spark = scores.sparkSession
    names = F.broadcast(spark.createDataFrame([(n,) for n, _ in BUCKETS], "bucket string"))
    groups = scores.select(*by).distinct().crossJoin(names) if by else names
    n = scores.groupBy(*by, "bucket").agg(F.count("*").alias("pages"))
    return groups.join(n, [*by, "bucket"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)))


def check_matrix(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by, check_id and the counts of each value, for all 36 checks of every group."""
    spark = verdicts.sparkSession
    dim = F.broadcast(checks_table(spark).select("check_id"))
    n = lambda v: F.count_if(F.col("value") == v)
    counts = verdicts.groupBy(*by, "check_id").agg(n("PASS").alias("pass"), n("FAIL").alias("fail"), n("N/A").alias("na"), n("NEEDS_REVIEW").alias("needs_review"))
    groups = verdicts.select(*by).distinct().crossJoin(dim) if by else dim
    return groups.join(counts, [*by, "check_id"], "left").fillna(0, ["pass", "fail", "na", "needs_review"])


def site_summary(scores: DataFrame) -> DataFrame:
    """site, pages, average_score and a count for each bucket."""
    n = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return scores.groupBy("site").agg(F.count("*").alias("pages"), (round_half_up(F.avg("score") * 100) / 100).alias("average_score"), *(n(b) for b, _ in BUCKETS))


def top_issues(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The k checks that fail most, in the order of checks where they tie."""
    return matrix.where((F.col("fail") > 0) | (F.col("needs_review") > 0)).orderBy(F.desc("fail"), "check_id").limit(k)


def coverage(scores: DataFrame, verdicts: DataFrame, total_urls: DataFrame, by: list[str], thorough: bool = False) -> DataFrame:
    """by, pages_analyzed, total_urls, residual_review and thorough."""
    a = scores.groupBy(*by).agg(F.count("*").alias("pages_analyzed"))
    b = total_urls.groupBy(*by).agg(F.count("*").alias("total_urls"))
    r = verdicts.groupBy(*by).agg(F.count_if(F.col("value") == "NEEDS_REVIEW").alias("residual_review"))
    return a.join(b, by).join(r, by).withColumn("thorough", F.lit(thorough))


def review_queue(verdicts: DataFrame) -> DataFrame:
    """Verdicts that need a review, with the severity rank to sort them by."""
    rank = F.create_map(*(F.lit(x) for p in (("Critical", 1), ("High", 2), ("Medium", 3), ("Low", 4)) for x in p))
    dim = F.broadcast(checks_table(verdicts.sparkSession).select("check_id", "severity", "ordinal"))
    return verdicts.where(F.col("value") == "NEEDS_REVIEW").join(dim, "check_id").withColumn("severity_rank", rank[F.col("severity")])
