"""Best-fit-decreasing packing of tokenised documents into sequences.

Best-fit decreasing depends only on how many pieces there are of each length, so the plan is made on the driver
from at most `capacity` counts, whatever the size of the corpus. A segment tree over remaining capacities finds
the tightest open bin; equal pieces are placed a run of equal bins at a time. The plan maps rank ranges of each
length to sequences and offsets, and rows meet it by their exact rank among the pieces of their length.

Defined results: a null text is an empty document, which is the end id alone; a document with up to `capacity`
ids is one piece; a longer one is cut so that all pieces but the first are full. Repeated rows are packed as
often as they occur, a null doc_id like any other; very long texts are cut, never shortened; pieces of equal length are
ordered by a hash and doc_id. Other columns, whatever their names, are not looked at. An empty table packs to an empty
result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagewright.llm.common import Scratch, documents, packed, unpacked

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length are ranked in buckets of about this many rows.
RANK_ROWS = 100_000


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelIds:
    """Ids of a byte-level BPE file (tokenizers' JSON), as little-endian 32-bit bytes.

    The file's vocabulary numbers tokens in the order of their merges, so its ids are also the ranks by which
    tiktoken merges, and that library's encoder gives the same ids several times faster. Added tokens of the file
    cut a text and are their own ids, as the tokenizers library has it; all texts go to that library where
    a flag or a normalizer of the file lets a token match other than its own string.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        # byte-level files write each byte as a printable character: these as themselves, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        known = set(merged)
        self.encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={t: i for t, i in ranks.items() if i in known or len(t) == 1}, special_tokens={})
        self.path, self._library = path, None
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.plain = not file.get("normalizer") and not any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip"))
        # the leftmost token, and of those that start there the longest
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def library(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def ordinary(self, text: str) -> bytes:
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).tobytes()
        except ValueError:  # about a million white-space characters in a row are beyond its regex
            return self.library(text)

    def encode(self, text: str) -> bytes:
        if not self.plain:
            return self.library(text)
        if not self.cuts:
            return self.ordinary(text)
        return b"".join(self.added.get(part) or self.ordinary(part) for part in self.cuts.split(text) if part)


#: How byte-level files of this kind split a text before merging. A fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> ByteLevelIds:
    """One encoder for each Python worker; kept on the tiktoken module since this function travels by value."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_pagewright_encoders", {})
    if path not in kept:
        kept[path] = ByteLevelIds(path)
    return kept[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with n ids; only the first may be short."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def tokenize_pieces(df: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of df(doc_id, text); with_ids adds the ids themselves."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = enc.encode(t.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * s : 4 * (s + n)]
                    for col, v in zip(out, (d, k, s, n, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(v)
            cols = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE + ", ids binary" * with_ids)


class CapacityTree:
    """A segment tree over remaining capacities; leaves count runs of open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [0] * (2 * self.size)

    def add(self, r: int, by: int) -> None:
        i = r + self.size
        while i:
            self.full[i] += by
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open bin has."""
        i = least + self.size
        if self.full[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths.

    Gives (length, first rank, end rank, first sequence, pieces in a row, place) and the number of sequences: the
    piece of rank k goes to sequence first + (k - first rank) // q at place + length * ((k - first rank) % q).
    A bin just filled is tighter than any other that is open, so it takes pieces of the same length while they fit.
    """
    tree, runs, plan, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(r: int, base: int, n: int) -> None:
        if r and n:
            runs[r].append((base, n))
            tree.add(r, 1)

    for length in sorted(counts, reverse=True):
        k, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, base = capacity, bins
                n = -(-left // (r // length))
                bins += n
            else:
                base, n = runs[r].pop()
                tree.add(r, -1)
            q = r // length
            whole = min(n, left // q)
            if whole:
                plan.append((length, k, k + whole * q, base, q, capacity - r))
                put(r - q * length, base, whole)
                k, left = k + whole * q, left - whole * q
            if whole < n and left:
                part = min(left, q)
                if part < q or whole < n:
                    plan.append((length, k, k + part, base + whole, part, capacity - r))
                    put(r - part * length, base + whole, 1)
                    k, left, whole = k + part, left - part, whole + 1
            put(r, base + whole, n - whole)
    return plan, bins


def pack(pieces: DataFrame, capacity: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """The rows of pieces with sequence_id and offset. pieces: a written table with doc_id, piece, length."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_best_fit(counts, capacity)
    buckets = [max(1, -(-counts.get(n, 0) // RANK_ROWS)) for n in range(capacity + 1)]  # of each length, by its own count
    of_length = F.array(*map(F.lit, buckets))[F.col("length").cast("int")]
    ranked = packed(pieces, length=F.col("length"), doc=F.col("doc_id"), piece=F.col("piece")).withColumn("b", F.pmod(F.xxhash64("doc", "piece"), of_length).cast("int"))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = ranked.groupBy("length", "b").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("length", "b").orderBy("doc", "piece")) - 1)
    if max(buckets) > 1:
        ranked = ranked.join(base.hint("shuffle_hash"), ["length", "b"]).withColumn("k", F.col("k") + F.col("base"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("l", "k0", "k1", "first", "q", "place")])
    by_length = spark.createDataFrame(plan, schema).groupBy("l").agg(F.sort_array(F.collect_list(F.struct("k0", "k1", "first", "q", "place"))).alias("runs"))
    # one row for each length, and runs that depend on the capacity alone: small by construction
    j = ranked.join(F.broadcast(by_length), F.col("length") == F.col("l"))
    j = j.withColumn("r", F.filter("runs", lambda x: (x["k0"] <= F.col("k")) & (F.col("k") < x["k1"]))[0]).withColumn("i", F.col("k") - F.col("r.k0"))
    sequence = F.col("r.first") + F.floor(F.col("i") / F.col("r.q")).cast("long")
    offset = F.col("r.place") + F.col("length") * F.pmod(F.col("i"), F.col("r.q"))
    return j.select(*unpacked([c for c in pieces.columns if c not in ("sequence_id", "offset")]), sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(df: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs df(doc_id, text)."""
    scratch = Scratch(df.sparkSession, "packing")
    return pack(scratch.table(tokenize_pieces(df, capacity, end_id, path, with_ids), "pieces"), capacity, scratch)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
