"""Quality rules with adaptive thresholds.

Features are exact counts over each whole text. Thresholds come from mergeable quantile sketches, one for each
(language, source) and metric: logarithmic histograms whose buckets hold exact counts, so that sketches of
partitions, sources and languages merge by adding counts and reruns agree. A quantile read from such a sketch
has a relative error of at most `alpha`. Sketches hold the texts that pass the base rule. The upper fence of a metric is
Q3 + spread * (Q3 - Q1), of all values, or of those above zero for events that a few normal texts have in number. A text
fails a metric if it has `few` events more than the fence allows at its length.
Groups with under `support` rows use the sketch of their language, and below that the one of the whole corpus.

Defined results: a null or empty text has no words and fails the base rule; a very long text is counted whole; null
lang and source form groups of their own; a null doc_id comes back as it is; repeated rows are counted as often as they
occur and judged alike; a value at its fence passes; where no text of any group has a value, or none passes the base
rule, the metric fails nothing; other columns, whatever their names, are not looked at, and the filter hands them on.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import Scratch, documents, packed, unpacked

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bang long"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window which occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    k = len(ids)
    if k < 2_000_000:
        key = (seq[:-2] * k + seq[1:-1]) * k + seq[2:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
    else:
        order = np.lexsort((seq[2:], seq[1:-1], seq[:-2]))
        rows = np.stack([seq[:-2], seq[1:-1], seq[2:]])[:, order]
        same = (rows[:, 1:] == rows[:, :-1]).all(axis=0)
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    dup, lines = 0, 0
    if "\n" in text:
        seen = set()
        for line in data.split(b"\n"):
            if line.strip():
                lines += 1
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    else:
        lines = int(bool(words))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        lines,
        len(data) - len(data.translate(None, UPPER)),
        text.count("!"),
    )


def add_counts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, and the counts of each whole text."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t.as_py()) for t in b.column(len(keep))]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, *names])

    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)]), COUNTS])
    return src.mapInArrow(run, schema)


@dataclass(frozen=True)
class AdaptiveRules:
    """Metrics are ratios of two counts: (events, of what, whether only values above zero are sketched, few)."""

    metrics: dict = field(
        default_factory=lambda: {
            "symbol_ratio": ("n_symbols", "word_chars", False, 5),
            "bang_ratio": ("n_bang", "word_chars", False, 5),
            "upper_ratio": ("n_upper", "word_chars", False, 5),
            "dup_line_ratio": ("n_dup_lines", "n_lines", True, 2),
            "repeat_ratio": ("n_repeat_words", "n_words", True, 6),
            "chars_per_word": ("word_chars", "n_words", False, 0),
        }
    )
    alpha: float = 0.01
    spread: float = 3.0
    support: int = 200
    min_words: int = 50
    max_repeat_percent: int = 50


def _value(rules: AdaptiveRules, m: str):
    a, b, *_ = rules.metrics[m]
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def _base_failed(rules: AdaptiveRules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def sketch(counts: DataFrame, rules: AdaptiveRules) -> DataFrame:
    """lang, source, metric, bucket, n: one logarithmic histogram for each group and metric, of texts that pass the base rule.

    Bucket b > -10^6 stands for the values in (g^(b-1), g^b], g = (1 + alpha) / (1 - alpha); zero has its own.
    """
    g = math.log((1 + rules.alpha) / (1 - rules.alpha))
    bucket = lambda v: F.when(v > 0, F.ceil(F.log(v) / F.lit(g)).cast("int")).otherwise(F.lit(-1_000_000))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(_value(rules, m)).alias("bucket")) for m in rules.metrics)))
    above = [m for m, (_, _, only_above, _) in rules.metrics.items() if only_above]
    some = (F.col("bucket") > -1_000_000) | ~F.col("metric").isin(above) if above else F.lit(True)
    return counts.where(~_base_failed(rules)).select("lang", "source", rows.alias("x")).select("lang", "source", "x.*").where(some).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sk: DataFrame, by: list[str], rules: AdaptiveRules) -> DataFrame:
    """Merges sketches by adding counts, and reads Q1 and Q3 of each group; n_rows is the group's support."""
    g = (1 + rules.alpha) / (1 - rules.alpha)
    merged = sk.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("n_rows", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n_rows"), F.col("bucket")))
    value = lambda b: F.when(b == -1_000_000, 0.0).otherwise(2 * F.pow(F.lit(g), b) / (g + 1))
    q = run.groupBy(*by, "metric").agg(at(0.25).alias("b1"), at(0.75).alias("b3"), F.max("n_rows").alias("n_rows"))
    return q.select(*by, "metric", "n_rows", value(F.col("b1")).alias("q1"), value(F.col("b3")).alias("q3"))


def fences(counts: DataFrame, sk: DataFrame, rules: AdaptiveRules) -> DataFrame:
    """lang, source, and a fence for each metric, from the finest sketch with enough support; null where there is none."""
    groups = counts.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", F.explode(F.array(*map(F.lit, rules.metrics))).alias("metric"))
    level = lambda by, k: quantiles(sk, by, rules).toDF(*(f"{c}{k}" for c in (*by, "metric", "n", "q1_", "q3_")))
    same = lambda k, *by: reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}{k}")) for c in by), F.col("metric") == F.col(f"metric{k}"))
    j = groups.join(level(["lang", "source"], 1), same(1, "lang", "source"), "left").join(level(["lang"], 2), same(2, "lang"), "left").join(F.broadcast(level([], 3)), same(3), "left")
    pick = lambda q: F.when(F.col("n1") >= rules.support, F.col(f"{q}_1")).when(F.col("n2") >= rules.support, F.col(f"{q}_2")).otherwise(F.col(f"{q}_3"))
    fence = pick("q3") + rules.spread * (pick("q3") - pick("q1"))
    return j.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, fence)).alias(f"fence_{m}") for m in rules.metrics))


def judge(counts: DataFrame, rules: AdaptiveRules, scratch: Scratch) -> DataFrame:
    """The rows of counts (a written table) with base_failed, failed_metrics and kept.

    Sketches and fences are tables of one row for each group and metric; the join on (lang, source) has one
    row on its right side for each group, so hot groups can be split.
    """
    table = scratch.table(fences(counts, scratch.table(sketch(counts, rules), "sketch"), rules), "fences").select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *(f"fence_{m}" for m in rules.metrics))
    j = counts.join(table, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    fails = lambda m, a, b, few: F.when(F.col(a) > F.col(f"fence_{m}") * F.col(b) + few, F.lit(m))
    failed = F.array_compact(F.array(*(fails(m, a, b, few) for m, (a, b, _, few) in rules.metrics.items())))
    return j.withColumn("base_failed", _base_failed(rules)).withColumn("failed_metrics", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_metrics") == 0)).drop("__l", "__s", *(f"fence_{m}" for m in rules.metrics))


def quality_verdicts(df: DataFrame, rules: AdaptiveRules | None = None) -> DataFrame:
    """For each row of df(doc_id, text, lang, source): its counts and verdicts; text_hash tells apart rows of one doc_id."""
    scratch = Scratch(df.sparkSession, "quality")
    src = df.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    return judge(scratch.table(add_counts(src, ["doc_id", "lang", "source", "text_hash"]), "counts"), rules or AdaptiveRules(), scratch)


def quality_filter(df: DataFrame, rules: AdaptiveRules | None = None) -> DataFrame:
    """The rows of df that are kept, with df's columns."""
    verdicts = quality_verdicts(df, rules).where("kept").select(F.col("doc_id").alias("d2"), F.col("text_hash").alias("h2"), F.col("lang").alias("l2"), F.col("source").alias("s2")).distinct()
    marked = packed(df, d=F.col("doc_id"), h=F.xxhash64("text"), l=F.col("lang"), s=F.col("source"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}2")) for c in "dhls"))
    return marked.join(verdicts.hint("shuffle_hash"), same, "left_semi").select(*unpacked(df.columns))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_metrics", ",").alias("failed_metrics")
    )
