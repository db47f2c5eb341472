"""Fix priorities of checks, over verdicts or a check matrix of each group of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.text import round_half_up
from pagewright.operators.checks import checks_table

BUCKETS = [("HIGH", 50), ("MEDIUM", 20), ("LOW", 5), ("NONE", None)]


def priority_bucket(p: Column) -> Column:
    return F.when(p >= 50, "HIGH").when(p >= 20, "MEDIUM").when(p >= 5, "LOW").otherwise("NONE")


def priority_rows(matrix: DataFrame, by: list[str]) -> DataFrame:
    """35 rows for each group: the fail share of passed and failed pages, weighed by severity, and its rank.

    The share is rounded to a percentage first and the product again; without a passed or failed page it is null
    and the priority 0.
    """
    dim = F.broadcast(checks_table(matrix.sparkSession).where("not excluded").select("check_id", "title", "severity", "gap_category", "factor"))
    seen = F.col("pass") + F.col("fail")
    share = F.when(seen > 0, round_half_up(F.col("fail").cast("double") / seen * 100.0).cast("double"))
    weighed = F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_half_up(F.col("fail_pct") * F.col("factor")).cast("double")))
    out = matrix.join(dim, "check_id").withColumn("fail_pct", share).withColumn("priority", F.when(F.col("fail_pct").isNull(), 0.0).otherwise(weighed)).withColumn("bucket", priority_bucket(F.col("priority")))
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), F.desc(F.coalesce("fail_pct", F.lit(-1.0))), "check_id")
    return out.withColumn("rank", F.row_number().over(order))


def priority_bucket_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    names = F.broadcast(rows.sparkSession.createDataFrame([(n,) for n, _ in BUCKETS], "bucket string"))
    n = rows.groupBy(*by, "bucket").agg(F.count("*").alias("checks"))
    groups = rows.select(*by).distinct().crossJoin(names) if by else names
    return groups.join(n, [*by, "bucket"], "left").withColumn("checks", F.coalesce("checks", F.lit(0)))


def dividers(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with starts_bucket: whether the bucket differs from that of the row ranked before."""
    before = F.lag("bucket").over(Window.partitionBy(*by).orderBy("rank"))
    return rows.withColumn("starts_bucket", F.coalesce(before != F.col("bucket"), F.lit(True)))


def cells(rows: DataFrame) -> DataFrame:
    """What a report shows of a row: the reason, and the class of its share."""
    p = F.col("fail_pct")
    why = F.when(p.isNull(), "not measured").when(p < 5, "rarely fails").otherwise("fails on pages")
    return rows.withColumn("why", why).withColumn("pct_class", F.when(p >= 60, "high").when(p >= 25, "mid").otherwise("low"))
