"""The seeded sample of a crawl, exactly as a shuffle of all pages in crawl order would give it.

The shuffle walks from the last place i to the first and swaps place i with a random place j(i) up to it. Its generator
is a counter under a hash, so each j(i) can be had by itself, and the shuffle need not be run: what ends at a place is
found by following the few swaps that moved it. What stands at place q before step x is what stood at i before step i, for the
least i > x with j(i) = q, or else q itself. All places of the sample go one swap further in each round, which is a scan
of a range of numbers for each round, about ln(n) of them; no list of pages is held anywhere.

Defined results: the order is that of the given column and of the URL where it ties; a sample of more than there is, is
all of it in shuffled order; an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.sources.scratch import Folder

WORD = 0xFFFFFFFF
#: Fixed values of the generator.
STEP, ODD = 0x6D2B79F5, 61
#: Rows of one range of ordinals, about.
RANGE_ROWS = 1_000_000


def generator(seed: int, n: int) -> float:
    """The n-th number of the generator, from 1 on, in [0, 1)."""
    a = (seed + n * STEP) & WORD
    t = (a ^ a >> 15) * (a | 1) & WORD
    t ^= t + (t ^ t >> 7) * (t | ODD) & WORD
    return (t ^ t >> 14) / 4294967296


def _times(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without passing 63 bits on the way."""
    low = x.bitwiseAND(0xFFFF) * y
    high = F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(WORD)


def generated(seed: int, n: Column) -> Column:
    """generator() as an expression of long numbers."""
    a = (_times(n.bitwiseAND(WORD), F.lit(STEP).cast("long")) + F.lit(seed & WORD).cast("long")).bitwiseAND(WORD)
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(ODD))).bitwiseAND(WORD))
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0


def with_ordinals(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ordinal, from 0 on in that order: counts of ranges first, places within a range next."""
    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).withColumn("__range", F.spark_partition_id())
    ranged = Folder(rows.sparkSession, "ordinals").written(ranged, "ranged")
    sizes, base = [], 0
    for r in ranged.groupBy("__range").count().orderBy("__range").collect():  # a row for each range
        sizes.append((r["__range"], base))
        base += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(sizes, "__range int, __base long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + F.col("__base")
    return ranged.join(starts, "__range").withColumn("ordinal", place.cast("long")).drop("__range", "__base")


def shuffled_places(spark: SparkSession, n: int, k: int, seed: int) -> list[int]:
    """Which of n places the first k of a shuffle hold."""
    swap = lambda i: int(generator(seed, n - i) * (i + 1))
    todo = {p: (swap(p) if p else 0, p) for p in range(min(k, n))}  # place of the sample: where to look, before which step
    out: dict[int, int] = {}
    while todo:
        asked = F.broadcast(spark.createDataFrame([(p, q, x) for p, (q, x) in todo.items()], "p long, q long, x long"))  # k rows at most
        i = F.col("id")
        swaps = spark.range(min(x for _, x in todo.values()) + 1, n).select(i, F.floor(generated(seed, F.lit(n) - i) * (i + 1)).cast("long").alias("j"))
        met = swaps.join(asked, (F.col("j") == F.col("q")) & (i > F.col("x"))).groupBy("p").agg(F.min("id").alias("i")).collect()
        further = {r["p"]: (r["i"], r["i"]) for r in met}
        out |= {p: q for p, (q, _) in todo.items() if p not in further}
        todo = further
    return [out[p] for p in range(min(k, n))]


def seeded_sample(pages: DataFrame, n: int = 25, seed: int = 42, order: str = "page_id") -> DataFrame:
    """n pages of pages(url, order) with place, their place in the sample."""
    keyed = with_ordinals(pages.select(F.col(order).alias("__at"), F.col("url").alias("__url")), ["__at", "__url"])
    places = shuffled_places(pages.sparkSession, keyed.count(), n, seed)
    chosen = F.broadcast(pages.sparkSession.createDataFrame(list(enumerate(places)), "place int, ordinal long"))  # n rows
    # rows that share both keys are told apart by their number among them
    nth = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(*c)).alias("__nth")
    marked = keyed.select("__at", "__url", "ordinal", nth("__at", "__url")).join(chosen, "ordinal").drop("ordinal")
    rows = pages.select("*", nth(order, "url").alias("__n"))
    same = F.col(order).eqNullSafe(F.col("__at")) & F.col("url").eqNullSafe(F.col("__url")) & (F.col("__n") == F.col("__nth"))
    return rows.join(F.broadcast(marked), same).drop("__n", "__at", "__url", "__nth")
