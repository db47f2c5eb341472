"""Histogram sort into shards of near-equal bytes, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together. Rounds of exact counts find the
splitters: each round sums bytes and rows in the bins of the intervals that still hold an unmet splitter, and the
next one divides only those. An interval whose rows share one hash (a large group of equal texts) is divided by
doc_id. A splitter is met when the bytes below it are within `tolerance` of a shard from their target, or when the
interval is a single key. Each shard gets several splitters at large sizes, so that no task sorts a whole shard;
rows are then exchanged once, by the part they fall in.

Defined results: a null text has size 1 and CRC 0; a null doc_id sorts first; repeated rows take neighbouring
slots; an empty table gives an empty result. A group of equal texts is cut only where a shard's bytes ask for it.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import Scratch, crc32_text, documents

LOW = -(2**63)
#: Bins that the driver sees in a round, about.
BINS = 1 << 17
#: A part, the unit of the exchange, has about this many rows.
PART_ROWS = 2_000_000


class Interval:
    """Keys [lo, hi] of one field under `head` (the hash, once that is settled), with what lies below them."""

    def __init__(self, lo: int, hi: int, below: int, rows_below: int, head: int | None = None):
        self.lo, self.hi, self.below, self.rows_below, self.head = lo, hi, below, rows_below, head

    @property
    def start(self) -> tuple[int, int]:
        return (self.lo, LOW) if self.head is None else (self.head, self.lo)

    def shift(self, fan: int) -> int:
        """Bins are 2**shift keys wide, so that no difference of two longs is needed; there are fan + 1 at most."""
        return max(0, (-(-(self.hi - self.lo + 1) // fan) - 1).bit_length())


def _at_or_above(keys: DataFrame, cuts: list[tuple[int, int]], name: str) -> DataFrame:
    """keys(h, d) with how many of the sorted cuts (h, d) each key lies at or above.

    The cuts, a few for each part, go to every task as a table by the leading bits of h; in one row of it, a binary search.
    """
    bits = max(1, len(cuts)).bit_length() + 1
    bins: list[list[tuple[int, int]]] = [[] for _ in range(1 << bits)]
    for h, d in cuts:
        bins[(h >> (64 - bits)) + (1 << (bits - 1))].append((h, d))
    rows, base = [], 0
    for k, own in enumerate(bins):
        rows.append((k - (1 << (bits - 1)), base, own))
        base += len(own)
    steps = max(map(len, bins)).bit_length()
    table = keys.sparkSession.createDataFrame(rows, "__bin long, __base int, __cuts array<struct<h:long,d:long>>")
    middle = "cast((a.lo + a.hi) div 2 as int)"
    above = f"__cuts[{middle}].h < h or (__cuts[{middle}].h = h and __cuts[{middle}].d <= d)"
    search = f"aggregate(sequence(1, {max(1, steps)}), struct(0 as lo, size(__cuts) as hi), (a, i) -> if(a.lo >= a.hi, a, if({above}, struct({middle} + 1 as lo, a.hi as hi), struct(a.lo as lo, {middle} as hi))), a -> a.lo)"
    j = keys.withColumn("__bin", F.shiftright("h", 64 - bits)).join(F.broadcast(table), "__bin")
    return j.withColumn(name, F.col("__base") + F.expr(search)).drop("__bin", "__base", "__cuts")


def _bins(keys: DataFrame, todo: list[Interval], fan: int) -> dict[int, list]:
    """Exact bytes, rows and extreme keys of each bin of each interval. Intervals are disjoint and in order."""
    spark = keys.sparkSession
    rows = [(n, i.lo, i.hi, i.head, i.shift(fan)) for n, i in enumerate(todo)]
    table = F.broadcast(spark.createDataFrame(rows, "w int, lo long, hi long, head long, shift int"))  # BINS rows at most
    placed = _at_or_above(keys.select("h", "d", "size"), [i.start for i in todo], "n").withColumn("w", F.col("n") - 1)
    v = F.when(F.col("head").isNull(), F.col("h")).otherwise(F.col("d"))
    inside = placed.join(table, "w").withColumn("v", v).where("v between lo and hi and (head is null or head = h)")
    inside = inside.withColumn("b", F.expr("shiftright(v, shift) - shiftright(lo, shift)"))
    got = inside.groupBy("w", "b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    out: dict[int, list] = {n: [] for n in range(len(todo))}
    for r in got.collect():  # about BINS rows
        out[r["w"]].append(r)
    return {n: sorted(v, key=lambda r: r["b"]) for n, v in out.items()}


def find_splitters(keys: DataFrame, parts: int, total: int, tolerance: int, group_tolerance: int) -> list[tuple[int, int, int, int]]:
    """(h, d, bytes below, rows below) of the parts - 1 splitters, in order. A part holds the keys from its splitter on."""
    found: dict[int, tuple[int, int, int, int]] = {}
    active = {Interval(LOW, 2**63 - 1, 0, 0): list(range(1, parts))} if parts > 1 else {}
    while active:
        todo = sorted(active, key=lambda i: i.start)
        bins = _bins(keys, todo, max(4, min(4096, BINS // len(todo))))
        after: dict[tuple, Interval] = {}
        waiting: dict[Interval, list[int]] = {}
        for n, i in enumerate(todo):
            got = bins[n]
            upto = list(accumulate((r["bytes"] for r in got), initial=i.below))
            rows_upto = list(accumulate((r["n"] for r in got), initial=i.rows_below))
            for s in active[i]:
                target = total * s // parts
                k = bisect_left(upto, target, 1) - 1
                if k >= len(got):
                    found[s] = (2**63 - 1, 2**63 - 1, upto[-1], rows_upto[-1])
                    continue
                r, below, rows = got[k], upto[k], rows_upto[k]
                lo_err, hi_err = target - below, upto[k + 1] - target
                start = (r["h0"], LOW if i.head is None else r["d0"])
                # the next key up: one past the largest of this bin
                end = (r["h1"], r["d1"] + 1) if i.head is not None else (r["h1"] + 1, LOW)
                single = r["h0"] == r["h1"] and r["d0"] == r["d1"]
                allowed = group_tolerance if r["h0"] == r["h1"] and i.head is None else tolerance
                if single or min(lo_err, hi_err) <= allowed:
                    low = lo_err <= hi_err or max(end) > 2**63 - 1
                    found[s] = (*start, below, rows) if low else (*end, upto[k + 1], rows_upto[k + 1])
                else:
                    same = r["h0"] == r["h1"]
                    key = (r["h0"], r["d0"]) if same else (r["h0"], None)
                    into = after.setdefault(key, Interval(r["d0"], r["d1"], below, rows, r["h0"]) if same else Interval(r["h0"], r["h1"], below, rows))
                    waiting.setdefault(into, []).append(s)
        active = waiting
    return [found[s] for s in range(1, parts)]


def shard_by_bytes(df: DataFrame, shards: int = 16, tolerance: float = 0.001, group_tolerance: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of df(doc_id, text); no shard is sorted in one task."""
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    keys = scratch.table(df.select(F.col("doc_id").cast("long"), size.alias("size"), crc32_text().alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d")), "keys")
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(1, -(-n // (shards * PART_ROWS)))
    parts = shards * per_shard
    cuts = find_splitters(keys, parts, total, int(tolerance * total / parts), int(group_tolerance * total / parts)) if n else []
    rows_below = [0, *(c[3] for c in cuts)]
    first = [(p, rows_below[p] - rows_below[p - p % per_shard]) for p in range(len(cuts) + 1)]
    starts = F.broadcast(spark.createDataFrame(first, "part int, first long"))  # one row for each part
    placed = _at_or_above(keys, [c[:2] for c in cuts], "part").join(starts, "part")
    slot = F.row_number().over(Window.partitionBy("part").orderBy("h", "d", "size", "text_crc32")) - 1 + F.col("first")
    return placed.withColumn("slot", slot.cast("long")).select("doc_id", "size", "text_crc32", (F.floor(F.col("part") / per_shard)).cast("int").alias("shard"), "slot")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
