"""Importance resampling towards a target distribution, over hashed runs of one to three words.

Each task puts the words of its partition into tries, a block of texts at a time. A node is a run of words; it holds how
often the run occurs and the CRC-32 of its bytes, made from its parent's CRC state and its own word. Counts fold into
bucket totals, and Spark merges those of all tasks. From the totals of the documents and of the target texts follows
each bucket's gain; a second pass attaches gains to the nodes, and a document's weight is their sum along its paths. A
seeded Gumbel term by doc_id turns the highest scores into a draw without replacement.

The driver sees `buckets` totals for each table, and one count for each range of scores. Ranks are made in ranges of
(score, doc_id), so no task sorts all documents.

Defined results: a null or empty text has no features, weight 0 and its Gumbel term as score, and is never drawn, since
it has fewer than `min_words` words; a very long text is cut into blocks, whose shared runs count once; repeated rows
are scored each, and drawn as often as their places allow; equal scores go by doc_id, a null one first; a null doc_id has
the Gumbel term of the empty string. Without target texts all gains come from the documents alone. Columns other than
doc_id and text, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import Scratch, documents
from pagewright.llm.words import Segment, Words, blocks, utf8

LONGEST = 3
BUCKETS = 10_000
#: A range of ranks has about this many rows.
RANGE_ROWS = 500_000


def _zero_bytes() -> np.ndarray:
    """[k][j][b]: the CRC register b << 8j after 2**k zero bytes. A CRC is linear, so a register is the sum of its bytes'."""
    step = np.array([[zlib.crc32(b"\0", b << 8 * j) ^ zlib.crc32(b"\0") for b in range(256)] for j in range(4)], np.uint32)
    out = [step]
    while len(out) < 32:
        step = _through(step, step)
        out.append(step)
    return np.array(out)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def extend(crc: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of A + B from those of A, those of B, and the lengths of B."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        out[at] = _through(ZERO_BYTES[k], out[at])
    return out ^ more


ZERO_BYTES = _zero_bytes()
_SPACE = zlib.crc32(b" ")


class WordTrie:
    """The runs of up to three words in a block of texts, level by level.

    crc[d][node] is the CRC state of a node at depth d + 1; paths[d] holds the node of every run of d + 1 words that is
    the block's own (that does not lie in the words repeated from the part before), and owner[d] its segment.
    """

    def __init__(self, block: list[Segment]):
        words = Words.of(block)
        ids, segment = words.ids, words.segment
        vocabulary = words.vocabulary.to_pylist()
        lengths = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        alone = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))
        spaced = np.fromiter((zlib.crc32(w, _SPACE) for w in vocabulary), np.uint32, len(vocabulary))
        first = np.searchsorted(segment, np.arange(len(block)))
        own_from = first + np.array([s.context for s in block])
        self.crc, self.paths, self.owner = [], [], []
        start, node, crc = np.arange(len(ids)), ids, alone
        for depth in range(LONGEST):
            if depth:
                go_on = start + depth < len(ids)
                go_on[go_on] = segment[start[go_on] + depth] == segment[start[go_on]]
                start = start[go_on]
                # a child is its parent's node and a word
                child = pa.array(node[go_on] * len(vocabulary) + ids[start + depth]).dictionary_encode()
                node = child.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                parent, word = np.divmod(child.dictionary.to_numpy(), max(1, len(vocabulary)))
                crc = extend(crc[parent], spaced[word], lengths[word] + 1)
            own = start + depth >= own_from[segment[start]]
            self.crc.append(crc)
            self.paths.append(node[own])
            self.owner.append(segment[start[own]])
        self.n_segments = len(block)
        self.n_words = np.bincount(self.owner[0], minlength=len(block))

    def bucket_counts(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for crc, path in zip(self.crc, self.paths, strict=True):
            count = np.bincount(path, minlength=len(crc))
            out += np.bincount(crc % buckets, weights=count, minlength=buckets).astype(np.int64)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and the sum of their gains, by segment. Sums of whole numbers below 2**53 are exact in doubles."""
        n, weight = np.zeros(self.n_segments, np.int64), np.zeros(self.n_segments)
        for crc, path, owner in zip(self.crc, self.paths, self.owner, strict=True):
            gain = gains[crc % len(gains)].astype(np.float64)
            n += np.bincount(owner, minlength=self.n_segments)
            weight += np.bincount(owner, weights=gain[path], minlength=self.n_segments)
        return n, weight.astype(np.int64)


def bucket_totals(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of df(text) that fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for block in blocks(utf8(b.column(0)), LONGEST - 1):
                total += WordTrie(block).bucket_counts(buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = df.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    s, t = found.astype(np.float64), wanted.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _totals(df: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in bucket_totals(df, buckets).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def feature_weights(df: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of df(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.zeros((3, len(b)), np.int64)
            for block in blocks(utf8(b.column(1)), LONGEST - 1):
                trie = WordTrie(block)
                rows = [s.row for s in block]
                for out, part in zip(sums, (trie.n_words, *trie.sums(gains)), strict=True):
                    np.add.at(out, rows, part)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, doc_id: str = "doc_id"):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a SHA-256 of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of df(doc_id, text); rank is null where it is not drawn."""
    scratch = Scratch(df.sparkSession, "resampling")
    gains = gains_of(_totals(df, buckets), _totals(target, buckets))
    scored = scratch.table(feature_weights(df, gains).withColumn("score", F.col("weight") + gumbel(seed)), "scores")
    long_enough = F.col("n_words") >= min_words
    n = scored.where(long_enough).count()
    ranges = max(1, -(-n // RANGE_ROWS))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    ranged = scratch.table(scored.where(long_enough).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())  # one row for each range
    draw, above, base = percent * n // 100, 0, []
    for k, rows in sizes:
        if above < draw:
            base.append((k, above))
        above += rows
    last = base[-1][0] if base else -1
    # at most one row for each range
    starts = F.broadcast(df.sparkSession.createDataFrame(base, "range int, above long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("above")
    top = ranged.where(F.col("range") <= last).join(starts, "range").withColumn("place", place)
    rest = ranged.where(F.col("range") > last).unionByName(scored.where(~long_enough), allowMissingColumns=True)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return top.select(*columns, F.when(F.col("place") <= draw, F.col("place")).cast("long").alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32; it is made byte by byte from the table of its polynomial, once for each distinct feature.
OP11_SQL = r"""
WITH RECURSIVE tab(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS f FROM d, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS f FROM b, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
hx AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
fb AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)), lambda a, y: xor(a >> 8, t[xor(a & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM hx, crc),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN fb USING (f) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN fb USING (f) GROUP BY ALL),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + 10000) / ((s.n + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN fb USING (f) JOIN g USING (bucket) GROUP BY doc_id),
sc AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN k <= 5 * n // 100 THEN k END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
