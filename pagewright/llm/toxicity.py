"""Toxicity scores from non-negative positive-unlabelled learning.

A logistic model over hashed word presence is fitted in numpy to confirmed toxic texts (positives) and to texts
without regard to labels (unlabelled). Its risk is prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]); where
the second term falls below zero, the step goes up that term's gradient instead, so that the model cannot fit the
unlabelled texts by driving an estimated loss under zero. The class prior is the share of toxic rows among the
labelled training rows.

Labels are read from training rows only: crc32 of the doc_id as text, mod 4, is not 2. Scores look at the text alone.
The fit takes at most `positives` toxic and `unlabelled` other texts, the first in the order of a hash of doc_id, one
text for each id, and of a text the first `most_features` of its hashed words in order of hash. These bounds are
documented parameters of the fit, and everything else covers all documents and whole texts.

Defined results: a null or empty text scores as a text without known words, a very long one by all of its words;
without any toxic training row every score is the prior (0 if there are no labels). Repeated rows, or rows that share a
doc_id, are scored each by its own text; a doc_id that `labels` names twice counts as toxic if one row says so; a null
doc_id or label is not learnt from. A score at the threshold counts as toxic. Columns other than doc_id, text and toxic,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import documents

BITS = 20
THRESHOLD = 0.3
EDGES = re.compile(r"[\W_]+")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _tokens(text: str | None) -> set[str]:
    return set(EDGES.sub(" ", (text or "").lower()).split())


class Buckets(dict):
    """Words to hashed features, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import zlib

        if len(self) > 1_000_000:
            self.clear()
        v = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return v


def _features(df: DataFrame) -> DataFrame:
    """y and xs, the sorted distinct features, of df(y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for b in batches:
            xs = [np.unique(np.fromiter(map(known.__getitem__, w), np.int32, len(w))).tobytes() for w in (_tokens(t.as_py()) for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.binary())], names=["y", "xs"])

    return df.select("y", "text").mapInArrow(run, "y int, xs binary")


@dataclass
class Model:
    prior: float
    bias: float
    weights: dict[int, float]

    def scorer(self):
        bias, weights = self.bias, self.weights
        known = Buckets()

        def score(text: str | None) -> float:
            z = bias + math.fsum({f: weights[f] for f in map(known.__getitem__, _tokens(text)) if f in weights}.values())  # in any order
            return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

        return score


def risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, float]:
    """The two terms of the risk at outputs z, positives first: prior * E_p[l(+)], and E_u[l(-)] - prior * E_p[l(-)]."""
    zp, zu = z[:n_p], z[n_p:]
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def slopes(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """What a step descends, by output: the whole risk's slopes; where its second term is below zero, that term's, turned round."""
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    g = np.empty(len(z))
    n_u = len(z) - n_p
    if risk(z, n_p, prior)[1] >= 0:
        g[:n_p] = -prior / n_p  # the slopes of l(+) and -l(-) add up to -1
        g[n_p:] = sig(z[n_p:]) / n_u
    else:
        g[:n_p] = prior * sig(z[:n_p]) / n_p
        g[n_p:] = -sig(z[n_p:]) / n_u
    return g


def _descend(row, column, value, n_p: int, n_u: int, d: int, prior: float, w, b: float, epochs: int, rate: float, shrink: float):
    """Proximal descent with momentum on the non-negative risk, all rows at once; `shrink` is the absolute-value penalty."""
    speed = np.zeros(d + 1)
    for _ in range(epochs):
        z = np.bincount(row, weights=w[column] * value, minlength=n_p + n_u) + b
        g = slopes(z, n_p, prior)
        grad = np.append(np.bincount(column, weights=g[row] * value, minlength=d), g.sum())
        speed = 0.9 * speed - rate * grad
        w = w + speed[:d]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * shrink)
        b += speed[d]
    return w, b


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, support: int = 8, sparsity: float = 0.1) -> Model:
    """Two descents: one with an absolute-value penalty of sparsity * prior, which leaves only words whose share among
    toxic texts differs by more than chance, and one without it over those words, which lets their weights grow.

    Features that fewer than `support` rows have are left out.
    """
    rows = pos + unl
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    feats, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count >= support
    column = np.where(keep, np.cumsum(keep) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row, column = row[column >= 0], column[column >= 0]
    feats = feats[keep]
    # words that most texts share say little; they weigh less while fitting, and the scale is folded in at the end
    idf = np.log(1 + len(rows) / count[keep]) / np.log(1 + len(rows) / support)
    b = float(np.log(prior / (1 - prior)))
    sizes = (len(pos), len(unl))
    w, b = _descend(row, column, idf[column], *sizes, len(feats), prior, np.zeros(len(feats)), b, FIRST_EPOCHS, FIRST_RATE, sparsity * prior)
    used = np.abs(w) > 1e-3
    place = np.where(used, np.cumsum(used) - 1, -1)[column]
    row, column = row[place >= 0], place[place >= 0]
    feats, idf, w = feats[used], idf[used], w[used]
    w, b = _descend(row, column, idf[column], *sizes, len(feats), prior, w, b, SECOND_EPOCHS, SECOND_RATE, 0.0)
    return Model(prior, float(b), {int(f): float(x) for f, x in zip(feats, w * idf, strict=True)})


FIRST_EPOCHS, FIRST_RATE, SECOND_EPOCHS, SECOND_RATE = 400, 0.1, 1500, 1.0


def train(df: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000, most_features: int = 4096) -> Model:
    """Fits on documents df(doc_id, text) and labels(doc_id, toxic): one text for each id, and most_features features of it."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model(0.0, -50.0, {})
    prior = min(0.9, max(1e-3, toxic / n))
    order = F.xxhash64("doc_id")
    pick = known.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives).withColumn("y", F.lit(1))
    others = df.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).withColumn("y", F.lit(0))
    # at most positives + unlabelled ids: a bounded list
    texts = df.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick.unionByName(others)), "doc_id")
    # of rows that share an id, the text with the least hash; so no id weighs more than another
    once = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    cut = F.substring("xs", 1, 4 * most_features)
    got = sorted((r["y"], bytes(r["xs"])) for r in _features(once).select("y", cut.alias("xs")).collect())
    rows = lambda y: [np.frombuffer(x, np.int32) for k, x in got if k == y]
    if not rows(1) or not rows(0):
        return Model(prior, float(np.log(prior / (1 - prior))), {})
    return fit_nnpu(rows(1), rows(0), prior)


def add_scores(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, and score, of df(..., text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in batches:
            s = pa.array([score(t.as_py()) for t in b.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), s], names=[*keep, "score"])

    src = df.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)])
    return src.mapInArrow(run, f"{kept}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = add_scores(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
