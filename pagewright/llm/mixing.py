"""Mixing sources to target weights, with DataFrame functions only.

Targets are filled like connected vessels: sources share a total by weight, none above twice its own size. Each
source's documents are put in a random order by a seeded hash, and equal runs of words in that order are its blocks, at
least `4 * shards` of them where it has so many words. Pass after pass over the blocks are the source's units; its quota
is the number of units up to its target. A splitting tree divides the quotas among output shards: at each node, those of
all sources are divided between the two halves of the shards by a multivariate hypergeometric draw, so that each shard
gets exact quotas that look like a random deal. The shards' quotas of a source are intervals of an affine permutation of
its units: a unit belongs to the shard whose interval holds its place, and one beyond all of them is not drawn. The last
unit of a source is drawn up to the target. Within a shard, a seeded hash gives the order.

The driver sees one row for each source, at most `most_sources` of them, and plans from those alone. Running sums are
two-level: hash ranges of a source first, rows of a range next, so that a hot source has no single task.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; documents without
words are drawn like others but add nothing; a very long text belongs to the block that it starts in; repeated rows are
drawn separately where their order tells them apart; a null doc_id is like any other; ties in the order go by doc_id and
size; columns of any name pass through the mix unchanged; an empty table gives an empty result; more sources than
`most_sources` are refused. Equal seeds give equal mixes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import WORD, Scratch, documents, packed, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of one hash range of one source, about.
RANGE_ROWS = 200_000


def fill_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets of sources: `share` of all words by weight; one that is above cap times its size stops there, again and again."""
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_tree(quotas: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact block quotas for each (shard, source): a tree of multivariate hypergeometric draws."""
    q = np.asarray(quotas, dtype=np.int64)
    if shards == 1:
        return q[None]
    left = shards // 2
    take = int(q.sum()) * left // shards
    mine = rng.multivariate_hypergeometric(q, take, method="marginals") if len(q) else q
    return np.vstack([split_tree(mine, left, rng), split_tree(q - mine, shards - left, rng)])


@dataclass
class Plan:
    """What rows of one source need: its blocks, its quota of units, and which of them go to which shard."""

    src: str
    source_size: int
    target: float
    n_blocks: int
    block_words: int
    last_words: float
    units: int
    step: int
    shift: int
    upto: list[int]


def plan_mix(totals: list[tuple[str, int]], weights: tuple, share: float, cap: float, shards: int, block_words: int, seed: int) -> list[Plan]:
    """Plans of sources (name, size), in order. `last_words`: how far the pass that reaches the target goes."""
    sizes = [n for _, n in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    blocks, quotas, last = [], [], []
    for n, t in zip(sizes, targets, strict=True):
        k = max(-(-n // block_words), min(4 * shards, n), 1)
        words = max(1, -(-n // k))
        k = max(1, -(-n // words))
        whole = int(t // n) if n else 0
        left = t - whole * n
        blocks.append((k, words))
        quotas.append(k * whole + (min(k, int(left // words) + 1) if left > 0 else 0))
        last.append(left if left > 0 else float(n))
    if sum(quotas) >= 10**9:
        raise ValueError("more than 10^9 blocks: raise block_words")
    rng = np.random.default_rng(seed)
    of_shard = split_tree(quotas, shards, rng)
    out = []
    for (src, n), t, (k, words), left, q in zip(totals, targets, blocks, last, of_shard.T, strict=True):
        units = max(1, int(q.sum()))
        step = int(rng.integers(1, max(2, units)))
        while gcd(step, units) != 1:
            step += 1
        out.append(Plan(src, n, t, k, words, left, units, step, int(rng.integers(0, units)), q.cumsum().tolist()))
    return out


PLAN = "src string, source_size long, target double, n_blocks long, block_words long, last_words double, units long, step long, shift long, upto array<bigint>"
NO_DRAWS = "array<struct<epoch:int,block:bigint,shard:int,place:bigint>>"


def mix(df: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, shards: int = 64, block_words: int = 1_000_000, seed: int = 17, most_sources: int = 100_000) -> DataFrame:
    """Every row of df(doc_id, source, text): size, source_size, target, and draws, an array of (epoch, block, shard, place)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = scratch.table(
        df.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")),
        "sizes",
    )
    totals = rows.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources to mix")
    totals.sort(key=lambda r: (r["src"] == "n", r["src"]))
    plans = plan_mix([(r["src"], r["size"]) for r in totals], weights, share, cap, shards, block_words, seed)
    plan = spark.createDataFrame([tuple(vars(p).values()) for p in plans], PLAN)
    ranges = max(16, -(-sum(r["n"] for r in totals) // RANGE_ROWS))
    keyed = rows.withColumn("rg", F.floor((F.shiftrightunsigned("h", 33)) * F.lit(ranges) / F.lit(1 << 31)).cast("int"))
    sums = keyed.groupBy("src", "rg").agg(F.sum("size").alias("s"))
    before = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("src").orderBy("rg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    w = Window.partitionBy("src", "rg").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # at most most_sources rows
    placed = keyed.withColumn("run", F.sum("size").over(w) - F.col("size")).join(before.hint("shuffle_hash"), ["src", "rg"]).join(F.broadcast(plan), "src")
    at = F.col("base") + F.col("run")
    placed = placed.withColumn("at", at).withColumn("block", F.least(F.floor(F.col("at") / F.col("block_words")), F.col("n_blocks") - 1).cast("long"))
    quota = F.element_at("upto", -1)  # all shards' quotas
    last_epoch = F.floor((quota - 1) / F.col("n_blocks"))

    def drawn(e):
        unit = e * F.col("n_blocks") + F.col("block")
        return (unit < quota) & ((e < last_epoch) | (F.col("at") + F.col("size") / 2 <= F.col("last_words")))

    def draw(e):
        place = F.pmod((e * F.col("n_blocks") + F.col("block")) * F.col("step") + F.col("shift"), F.col("units"))
        shard = F.size(F.filter("upto", lambda x: x <= place)).cast("int")
        return F.struct(e.cast("int").alias("epoch"), F.col("block").alias("block"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), shard, "h", e.cast("int")).alias("place"))

    epochs = F.array(*(F.lit(e).cast("long") for e in range(int(np.ceil(cap)))))
    source = F.when(F.col("src") != "n", F.substring("src", 2, 2_147_483_647))
    return placed.select("doc_id", source.alias("source"), "h", "size", "source_size", "target", F.transform(F.filter(epochs, drawn), draw).cast(NO_DRAWS).alias("draws"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The documents of the mix, as often as it takes them, sorted by shard and place; columns as in df."""
    seed = options.get("seed", 17)
    m = mix(df, **options).groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.flatten(F.collect_list("draws")).alias("draws"), F.count("*").alias("n"))
    m = Scratch(df.sparkSession, "mixed").table(m.where(F.size("draws") > 0), "draws")
    rows = packed(df, d=F.col("doc_id"), h=F.xxhash64(F.lit(seed), "doc_id", "text"))
    if m.where("n > 1").limit(1).count():  # repeated rows: one of them stands for the draws of all
        rows = rows.dropDuplicates(["d", "h"])
    j = rows.join(m.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))).select("row", F.explode("draws").alias("w"))
    return j.repartitionByRange("w.shard", "w.place").sortWithinPartitions("w.shard", "w.place").select(*unpacked(df.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    each = F.transform("draws", lambda x: F.concat_ws(":", x["epoch"], x["block"], x["shard"], x["place"]))
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), F.array_join(each, ",").alias("draws"))
