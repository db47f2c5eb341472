"""Connected components by alternating large-star and small-star steps.

Edges stay in tables; the driver sees two numbers a step. In a large-star step every node links its larger
neighbours to the least node around it, in a small-star step its smaller ones; the edge set ends as stars whose
centres are the least nodes. The least neighbour of each node is written first, so that the join that follows has
plain exchanges on both sides and a centre with very many neighbours can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    out = scratch.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    scratch.drop(least)
    return out


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    out = scratch.table(out, "small")
    scratch.drop(least)
    return out


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: each node that is not the least of its component, and that least node. edges: u, v longs, no nulls or loops."""
    now = scratch.table(edges.select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        large = _large_star(now, scratch)
        small = _small_star(large, scratch)
        scratch.drop(now, large)
        before, mark, now = mark, _mark(small), small
        if mark == before:
            break
    return now
