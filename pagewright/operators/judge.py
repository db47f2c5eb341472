"""Merging second opinions into verdicts that need a review."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_judgements(verdicts: DataFrame, judgements: DataFrame, judge: str = "judge") -> DataFrame:
    """verdicts(..., hash, check_id, value, evidence) with judgements(hash, check_id, value, evidence, confidence, error).

    Only NEEDS_REVIEW rows change. An error leaves the value and is told in the evidence; no value, or another
    NEEDS_REVIEW, leaves it as inconclusive; another value replaces it. heuristic_value and heuristic_evidence keep
    what stood before; outcome is judged, failed, unchanged or null.
    """
    j = judgements.select(F.col("hash").alias("__h"), F.col("check_id").alias("__c"), F.col("value").alias("__v"), F.col("evidence").alias("__e"), F.col("confidence").try_cast("double").alias("__p"), F.col("error").alias("__x"), F.lit(True).alias("__there"))
    open_ = F.col("value") == "NEEDS_REVIEW"
    m = verdicts.join(j, open_ & (F.col("hash") == F.col("__h")) & (F.col("check_id") == F.col("__c")), "left")
    failed = open_ & F.col("__x").isNotNull()
    judged = open_ & ~failed & F.coalesce((F.col("__v") != "") & (F.col("__v") != "NEEDS_REVIEW"), F.lit(False))
    outcome = F.when(failed, "failed").when(judged, "judged").when(open_, "unchanged")
    evidence = F.when(failed, F.concat(F.lit("judge failed: "), "__x")).when(judged, F.coalesce(F.nullif("__e", F.lit("")), "evidence")).when(open_, F.coalesce(F.nullif("__e", F.lit("")), F.concat("evidence", F.lit(" (judge inconclusive)")))).otherwise(F.col("evidence"))
    kept = [x for x in verdicts.columns if x not in ("value", "evidence")]
    return m.select(*kept, F.col("value").alias("heuristic_value"), F.col("evidence").alias("heuristic_evidence"), F.when(judged, F.col("__v")).otherwise(F.col("value")).alias("value"), evidence.alias("evidence"), F.when(open_ & ~failed, judge).alias("judged_by"), F.when(judged, F.col("__p")).alias("confidence"), outcome.alias("outcome"))


#: What apply_judgements() adds; an analysis that was judged before has them, and they are made anew.
ADDED = ["heuristic_value", "heuristic_evidence", "judged_by", "confidence", "outcome"]


def tally_columns() -> list:
    """judged, failed, unchanged and residual, as aggregates: of a query, or observed while one writes."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return [n("judged").alias("judged"), n("failed").alias("failed"), n("unchanged").alias("unchanged"), (n("failed") + n("unchanged")).alias("residual")]


def tallies(judged: DataFrame) -> DataFrame:
    return judged.agg(*tally_columns())


def invoke_judge(queue: DataFrame, judge: Callable[[dict], dict | None]) -> DataFrame:
    """A judgements table from a Python function called with each row of the queue, on the executors.

    An exception becomes the error of its row; None is no judgement.
    """

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    r = judge(row) or {}
                    out.append((row["hash"], row["check_id"], r.get("value"), r.get("evidence"), str(r["confidence"]) if isinstance(r.get("confidence"), int | float) else None, None))
                except Exception as e:  # a judge is foreign code; its failure is a result
                    out.append((row["hash"], row["check_id"], None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["hash", "check_id", "value", "evidence", "confidence", "error"])

    return queue.mapInPandas(run, "hash string, check_id string, value string, evidence string, confidence string, error string")
