"""Ranked lexical search: the best documents for each of a set of items, by inverted treaps.

One pass over all documents keeps, for each, its length and how often it holds each term that some item asks for.
Counts over all documents (N, L, and how many hold a term) fix the terms' weights. Each task then builds treaps of its
documents, a block at a time, and traverses them for every item; its k best documents go on, and a window over what the
tasks found gives the k best of all. Items are handled in blocks of a bounded number of terms, so that what the driver
holds and sends to tasks is bounded whatever the number of items; each block is one pass over the documents.

Defined results: a null or empty text has no terms and is in no result, but a null doc_id is like any other, first
among equals; an item without terms has no rows; repeated rows of documents are ranked each, repeated items each give
their rows; a very long text is cut into blocks whose counts add up; equal scores go by doc_id. Columns other than
doc_id, item_id and text, whatever their names, are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import Scratch, documents
from pagewright.llm.treaps import Best, InvertedTreaps, traverse
from pagewright.llm.words import Words, blocks, utf8

#: Terms of items, repeats within an item not counted, that one block of items has at most; an item with more is a block alone.
ITEM_TERMS = 200_000
#: Postings of one set of treaps, about.
POSTINGS = 1_000_000
LOWEST = -(2**63)


def _term_counts(texts: list[bytes | None], wanted: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(row, words, terms, times, vocabulary) of each text or part of one; terms are places in `wanted`, else in the vocabulary."""
    for block in blocks(texts):
        words = Words.of(block)
        term = words.ids
        if wanted is not None:
            place = pa.compute.index_in(words.vocabulary, wanted).fill_null(-1).to_numpy(zero_copy_only=False)
            term = place[words.ids] if len(words.ids) else words.ids
        n_words = np.bincount(words.segment, minlength=len(block))
        known = term >= 0
        pairs, times = np.unique(words.segment[known] * (1 << 32) + term[known], return_counts=True)
        cuts = np.searchsorted(pairs >> 32, np.arange(len(block) + 1))
        for k, s in enumerate(block):
            own = slice(cuts[k], cuts[k + 1])
            yield s.row, int(n_words[k]), pairs[own] & 0xFFFFFFFF, times[own], words.vocabulary


def _by_row(counts: Iterator) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same with the parts of long texts added up."""
    open_: list = []

    def close():
        row, n = open_[0][0], sum(p[1] for p in open_)
        if len(open_) == 1:
            return row, n, open_[0][2], open_[0][3]
        term, at = np.unique(np.concatenate([p[2] for p in open_]), return_inverse=True)
        return row, n, term, np.bincount(at, weights=np.concatenate([p[3] for p in open_]), minlength=len(term)).astype(np.int64)

    for part in counts:
        if open_ and part[0] != open_[0][0]:
            yield close()
            open_ = []
        open_.append(part[:4])
    if open_:
        yield close()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms and times of each row of items(item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(utf8(b.column(1))):
                found: dict[str, int] = {}
                for _, _, term, times, vocabulary in _term_counts([text], None):
                    for w, n in zip(vocabulary.take(pa.array(term)).to_pylist(), times.tolist(), strict=True):
                        found[w.decode()] = found.get(w.decode(), 0) + n
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, terms array<string>, times array<bigint>")


def index_documents(df: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (words), and the places in `terms` that each text of df(doc_id, text) holds, with how often, as 32-bit bytes."""
    # the terms of one block of items: bounded by ITEM_TERMS, or by one item's text
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array([t.encode() for t in shared.value], pa.large_binary())
        for b in batches:
            rows = [(n, t.astype("<u4").tobytes(), k.astype("<u4").tobytes()) for _, n, t, k in _by_row(_term_counts(utf8(b.column(1)), wanted))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["doc_id", "n", "terms", "times"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms binary, times binary")


def holders(index: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row for each term of the block
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, n_words: np.ndarray, n: int, words: int) -> np.ndarray:
    """What a term adds to the score of a document with n_words words, among n documents of `words` words in all."""
    m = 25 + (75 * n_words * n) // max(1, words)
    return weight * (1_000_000_000 * times // (1000 * times + 8 * m))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about POSTINGS postings; one row alone may have more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(2)).to_numpy(zero_copy_only=False)) // 4
        at = 0
        while at < len(b):
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + POSTINGS - n, "right")))
            held.append(b.slice(at, stop - at))
            n, at = n + int(ends[stop - 1]) - done, stop
            if n >= POSTINGS or at < len(b):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def treaps_of(index: pa.RecordBatch, weight: np.ndarray, n: int, words: int) -> tuple[InvertedTreaps, np.ndarray, np.ndarray]:
    """Treaps over the rows of an index, with doc_id by document and whether it is known."""
    known = np.array(index.column(0).is_valid())
    doc_id = index.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((doc_id, known))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms, times = (index.column(c).to_pylist() for c in (2, 3))
    doc = np.repeat(place, [len(x) // 4 for x in terms])
    term, often = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (terms, times))
    impact = impacts(weight[term], often, index.column(1).to_numpy()[order][doc], n, words)
    by = np.lexsort((doc, term))
    return InvertedTreaps(term[by], doc[by], impact[by]), doc_id[order], known[order]


def best_of_tasks(index: DataFrame, items: list[list[tuple[int, int]]], weight: np.ndarray, n: int, words: int, k: int) -> DataFrame:
    """item (its place in items), doc_id and score of the k best documents of every task; items are lists of (term, times)."""
    # bounded as in index_documents
    shared = index.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        best = [Best(k) for _ in wanted]
        for part in _parts(batches):
            treaps, doc_id, known = treaps_of(part, weight, n, words)
            for terms, b in zip(wanted, best, strict=True):
                traverse(treaps, terms, doc_id, known, b)
        for i, b in enumerate(best):
            if len(b.doc):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(b.doc), pa.int32()), pa.array(b.doc, pa.int64(), mask=~b.known), pa.array(b.score)], names=["item", "doc_id", "score"])

    return index.where("n > 0").mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(df: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best rows of df(doc_id, text) for each row of items(item_id, text)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "search")
    asked = scratch.table(item_terms(items), "items")
    n_blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS))
    found = []
    for block in range(n_blocks):
        # about ITEM_TERMS terms; repeated items of one block are told apart by their place
        rows = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)) == block).where(F.size("terms") > 0).collect()
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        at = {t: i for i, t in enumerate(vocabulary)}
        index = scratch.table(index_documents(df, vocabulary), "index")
        n, words = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = weights(holders(index, len(vocabulary)), n)
        best = best_of_tasks(index, [[(at[t], c) for t, c in zip(r["terms"], r["times"], strict=True)] for r in rows], weight, n, words, k)
        ids = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long"))  # as many as the block's items
        found.append(scratch.table(best.join(ids, "item").withColumn("block", F.lit(block)), "best"))
        scratch.drop(index)
    best = reduce(DataFrame.unionByName, found)
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    for by in (["block", "item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["block", "item"]):  # first in parts: each task has found k
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
g AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT p.doc_id, p.t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS impact
  FROM p JOIN df USING (t), g WHERE p.t IN (SELECT t FROM q)),
s AS (SELECT item_id, doc_id, sum(k * impact)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
