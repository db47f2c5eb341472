"""Keeping scores, matrices and priorities up to date from what changed in the verdicts.

A changed verdict is two signed rows: the old value is taken back, the new one added. What the views hold is made of
sums over verdicts, so signed sums fold into them, and only the pages, (site, check) cells and sites that a delta names
are touched. Points lost are kept beside a score, because the score itself stops at 0 and 100 and cannot be added to.

Defined results: a verdict judged to the value it had makes no rows; two deltas fold in any order, and a delta and its
opposite leave a view as it was; a delta of a page or cell that a view lacks starts from nothing, and rows that fall to
no verdict at all go. Points are multiples of a half, so sums of them are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import priority
from pagewright.operators.checks import NEEDS_REVIEW_PENALTY, VALUES, checks_table
from pagewright.operators.scoring import score_bucket

PAGE = ["site", "page_id", "url"]
CELL = ["site", "check_id"]
COUNTS = dict(zip(VALUES, ("pass", "fail", "na", "needs_review"), strict=True))


def signed(before: DataFrame, sign: int = 1) -> DataFrame:
    """Whole verdicts(site, page_id, url, check_id, value) as a delta: all added, or all taken back."""
    return before.select(*PAGE, "check_id", "value", F.lit(sign).alias("sign"))


def judgement_deltas(judged: DataFrame) -> DataFrame:
    """site, page_id, url, check_id, value and sign: what apply_judgements() changed."""
    changed = judged.where(~F.col("value").eqNullSafe(F.col("heuristic_value")))
    sides = F.explode(F.array(F.struct(F.col("heuristic_value").alias("value"), F.lit(-1).alias("sign")), F.struct(F.col("value").alias("value"), F.lit(1).alias("sign"))))
    return changed.select(*PAGE, "check_id", sides.alias("d")).select(*PAGE, "check_id", "d.value", "d.sign")


def points(delta: DataFrame) -> DataFrame:
    """site, page_id, url, n (verdicts) and lost (points) that a delta adds to each page."""
    dim = F.broadcast(checks_table(delta.sparkSession).select("check_id", "weight"))
    lost = F.when(F.col("value") == "FAIL", F.col("weight")).when(F.col("value") == "NEEDS_REVIEW", NEEDS_REVIEW_PENALTY).otherwise(0.0)
    return delta.join(dim, "check_id").groupBy(*PAGE).agg(F.sum("sign").alias("n"), F.sum(lost * F.col("sign")).alias("lost"))


def cells(delta: DataFrame) -> DataFrame:
    """site, check_id and what a delta adds to the count of each value."""
    return delta.groupBy(*CELL).agg(*(F.sum(F.when(F.col("value") == v, F.col("sign")).otherwise(0)).alias(c) for v, c in COUNTS.items()))


def folded(view: DataFrame, change: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """view with the sums of change added by key. Changes are few; where they are small, the view is not shuffled."""
    same = reduce(lambda a, b: a & b, (F.col(f"v.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys))
    old = view.alias("v").join(change.alias("c"), same, "left")
    kept = old.select(*(F.col(f"v.{k}") for k in keys), *((F.col(f"v.{s}") + F.coalesce(F.col(f"c.{s}"), F.lit(0))).alias(s) for s in sums))
    fresh = change.alias("c").join(view.select(*keys).alias("v"), same, "left_anti").select(*keys, *sums)
    return kept.unionByName(fresh)


@dataclass
class Views:
    """points: site, page_id, url, n, lost. matrix: site, check_id and a count for each value. ranked: the priorities of sites."""

    points: DataFrame
    matrix: DataFrame
    ranked: DataFrame

    @classmethod
    def of(cls, verdicts: DataFrame) -> Views:
        every = signed(verdicts)
        matrix = cells(every)
        return cls(points(every), matrix, priority.priority_rows(_whole(matrix), ["site"]))

    def apply(self, delta: DataFrame) -> Views:
        """The views after a delta(site, page_id, url, check_id, value, sign). Priorities are made again for its sites alone."""
        page, cell = points(delta), cells(delta)
        matrix = folded(self.matrix, cell, CELL, list(COUNTS.values()))
        matrix = matrix.where(reduce(lambda a, b: a + b, map(F.col, COUNTS.values())) > 0)
        touched = cell.select("site").distinct()
        same = F.col("r.site").eqNullSafe(F.col("t.site"))
        again = matrix.alias("r").join(touched.alias("t"), same, "left_semi")
        rest = self.ranked.alias("r").join(touched.alias("t"), same, "left_anti")
        return replace(self, points=folded(self.points, page, PAGE, ["n", "lost"]).where("n > 0"), matrix=matrix, ranked=rest.unionByName(priority.priority_rows(_whole(again), ["site"])))

    def written(self, write) -> Views:
        """The views as write(df, name) stores them and reads them back."""
        return Views(write(self.points, "points"), write(self.matrix, "matrix"), write(self.ranked, "ranked"))

    def scores(self) -> DataFrame:
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("lost")))
        return self.points.select(*PAGE, score.alias("score")).withColumn("bucket", score_bucket(F.col("score")))

    def check_matrix(self) -> DataFrame:
        """As check_matrix() gives it: all checks of every site."""
        return _whole(self.matrix)


def _whole(matrix: DataFrame) -> DataFrame:
    dim = F.broadcast(checks_table(matrix.sparkSession).select("check_id"))  # 36 rows
    return matrix.select("site").distinct().crossJoin(dim).join(matrix, CELL, "left").fillna(0, list(COUNTS.values()))
