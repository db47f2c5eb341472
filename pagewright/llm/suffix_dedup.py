"""Removal of byte strings that an earlier document already holds, by suffix sorting.

A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller doc_id. A global
suffix array over all bytes moves every position several times; so positions are cut down exactly first:

1. Texts equal as a whole are found by a 128-bit digest. All but the one of the least doc_id go whole.
2. The others are put, a megabyte or so together, in compressed blocks. Every 50-byte window has an anchor, the least
   20-gram hash in it (a minimizer); equal windows have equal anchors at equal offsets. A block sends each range of hash
   values its own, sorted, shortened and as differences; the range answers which of them occur in two or more texts.
   Only those are hot, that is, can matter.
3. Around each hot anchor lies a segment: the windows that it owns. Equal segments of an anchor are one variant
   with its least doc_id (an aggregation, so a passage of very many documents is one row).
4. Anchors with several variants go through the difference-cover suffix sort: a task takes the variants of whole
   anchors, a few megabytes at a time, sorts sampled triples, recurses on names, merges the remaining suffixes, and
   compares the 50-byte prefixes of adjacent window starts. Each run of equal prefixes gets its least doc_id. An anchor
   of more than `MANY` variants (a ruler, a stock phrase) is first split into its windows, whose least doc_id is an
   aggregation by (anchor, window); so no task holds more than a bounded group.
5. Occurrences look up the least doc_id of each of their windows; windows with a smaller one than their own document
   are covered spans, merged for each document and cut from its text in its block.

Defined results: null and short texts (under 50 bytes) lose nothing; a null doc_id counts as smaller than all others;
rows that share a doc_id never remove from each other, so repeated rows all come back alike; very long texts are blocks
of their own; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, documents
from pagewright.llm.suffix_array import suffix_array

SPAN = 50
GRAM = 20
OWNERS = SPAN - GRAM + 1  # grams of a window
GROUP_BYTES = 4_000_000
#: Variants of one anchor that a task sorts together at most.
MANY = 4096
BLOCK_BYTES = 1 << 20
#: Anchors are gone through in so many parts, by their hash, which keeps the shuffles of each part small.
PASSES = 2
#: Bytes whose hashes are worked on together, so that they stay in a core's cache.
STEP = 1 << 15
#: Hash values that one range holds, about.
RANGE_VALUES = 4_000_000
NULL_ID = -(2**63)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Mixed hashes of all 20-grams of bytes: 16-grams by doubling, and the four bytes after."""
    h, w, m, four = x.astype(np.uint64), 1, 0x9E3779B97F4A7C15, None
    while w < 16:
        h = h[:-w] * np.uint64(m) + h[w:]
        h ^= h >> np.uint64(32)
        m = (m * 0xD6E8FEB86659FD93 | 1) & 0xFFFFFFFFFFFFFFFF
        w *= 2
        four = h if w == GRAM - 16 else four
    h = h[: len(x) - GRAM + 1] * np.uint64(m) + four[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _hashes_and_minima(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram and the least one of each window."""
    n = len(x) - GRAM + 1
    h, s = np.empty(n, np.uint64), np.empty(n - OWNERS + 1, np.uint64)
    for a in range(0, len(s), STEP):
        part = gram_hashes(x[a : a + STEP + SPAN - 1])
        h[a : a + len(part)] = part
        w = 1
        while 2 * w <= OWNERS:
            part = np.minimum(part[:-w], part[w:])
            w *= 2
        if OWNERS > w:
            part = np.minimum(part[: len(part) - (OWNERS - w)], part[OWNERS - w :])
        s[a : a + len(part)] = part
    return h, s


def anchors(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts that stand one after another in x and end at `ends`, each of SPAN bytes or more: hash, position,
    first and last owned window start, and text. A window belongs to its leftmost least gram."""
    h, s = _hashes_and_minima(x)
    # s[i]: the least hash of window i. The window's anchor changes where that hash does, or where it falls off the left end.
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (h[: len(s) - 1] == s[:-1])
    new[ends[:-1]] = True
    across = (ends[:-1, None] - (SPAN - 1) + np.arange(SPAN - 1)).ravel()  # windows that lie in two texts
    new[across] = False
    starts = np.flatnonzero(new)
    of = np.searchsorted(ends, starts, side="right")
    last = np.minimum(np.append(starts[1:], len(x)) - 1, ends[of] - SPAN)
    want = s[starts]
    p = np.full(len(starts), -1)
    miss = np.arange(len(starts))
    for k in range(OWNERS):
        hit = h[starts[miss] + k] == want[miss]
        p[miss[hit]] = starts[miss[hit]] + k
        miss = miss[~hit]
        if not len(miss):
            break
    return want, p, starts, last, of


def _pack(values: np.ndarray, base: int) -> bytes:
    """Sorted values from base on, as differences of equal width; the first byte is the width."""
    d = np.diff(values, prepend=np.uint64(base))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, base: int) -> np.ndarray:
    width = data[0]
    d = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    d[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


class Hashes:
    """How anchors are shortened and dealt to ranges: `bits` of a hash are told apart, its first `range_bits` are its range."""

    def __init__(self, n_bytes: int, least_ranges: int):
        n = max(1, n_bytes // 16)
        self.range_bits = max(0, math.ceil(math.log2(max(least_ranges, n / RANGE_VALUES))))
        # one unhot anchor in a few hundred meets another's shortened hash, which costs some work and changes nothing
        self.bits = min(62, max(self.range_bits + 8, math.ceil(math.log2(n)) + 8))

    def short(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def base(self, r: int) -> int:
        return r << (self.bits - self.range_bits)


def _block(docs: list[int], digests: list[bytes], texts: list[bytes], number: int, hashes: Hashes) -> dict:
    import zstandard

    ends = np.cumsum([len(t) for t in texts])
    joined = b"".join(texts)
    h, _, _, _, of = anchors(np.frombuffer(joined, np.uint8), ends)
    t = hashes.short(h)
    order = np.argsort(t, kind="stable")
    t, of = t[order], of[order]
    t = t[np.concatenate([[True], (t[1:] != t[:-1]) | (of[1:] != of[:-1])])]  # once for each text
    t = t[np.concatenate([[True] * min(2, len(t)), t[2:] != t[:-2]])]  # twice says that two texts have it
    r = t >> np.uint64(hashes.bits - hashes.range_bits)
    cuts = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(t)]]).tolist()
    items = [{"r": int(r[a]), "values": _pack(t[a:z], hashes.base(int(r[a])))} for a, z in zip(cuts, cuts[1:], strict=False)]
    return {"block": number, "docs": docs, "digests": digests, "ends": ends.tolist(), "texts": zstandard.compress(joined, 3), "items": items}


BLOCK = "block long, docs array<long>, digests array<binary>, ends array<long>, texts binary, items array<struct<r:int,values:binary>>"


def blocks(df: DataFrame, hashes: Hashes) -> DataFrame:
    """Blocks of df(doc, digest, text), whose texts have SPAN bytes or more."""
    array = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("docs", array), ("digests", pa.list_(pa.binary())), ("ends", array), ("texts", pa.binary()), ("items", pa.list_(pa.struct([("r", pa.int32()), ("values", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        docs, digests, texts, size = [], [], [], 0
        for b in batches:
            for d, g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs.append(d)
                digests.append(g)
                texts.append(t.as_py().encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([_block(docs, digests, texts, number, hashes)], schema)
                    number, docs, digests, texts, size = number + 1, [], [], [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([_block(docs, digests, texts, number, hashes)], schema)

    return df.select("doc", "digest", "text").mapInArrow(run, BLOCK)


def hot_values(items: DataFrame, hashes: Hashes) -> DataFrame:
    """block, r and values: of what each block sent to a range, those that two or more texts have. items: block, r, values."""

    def run(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        base = hashes.base(r)
        parts = [_unpack(v.as_py(), base) for v in t.column("values")]
        of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        v = np.concatenate(parts)
        order = np.argsort(v, kind="stable")
        s = v[order]
        same = s[1:] == s[:-1]
        hot = np.zeros(len(v), bool)
        hot[order[1:][same]] = True
        hot[order[:-1][same]] = True
        at = np.flatnonzero(hot)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of[at])) + 1, [len(at)]]).tolist() if len(at) else [0]
        block = t.column("block").to_pylist()
        out = [(block[of[at[a]]], r, _pack(np.unique(v[at[a:z]]), base)) for a, z in zip(cuts, cuts[1:], strict=False)]
        return pa.table([pa.array([x[k] for x in out], ty) for k, ty in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "r", "values"])

    return items.select("block", "r", "values").groupBy("r").applyInArrow(run, "block long, r int, values binary")


def _texts(packed: bytes, ends: list[int]) -> tuple[bytes, np.ndarray]:
    import zstandard

    return zstandard.decompress(packed), np.array(ends, np.int64)


def _slices(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of x as binary values."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x[at]))])


def segments(df: DataFrame, hashes: Hashes) -> DataFrame:
    """h, seg, back, doc, block, i and pos of the hot anchors of df(block, docs, ends, texts, hot): the segment's bytes, how
    far the anchor lies behind its start, and where it stands, that is in text i of the block at pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                data, ends = _texts(b.column(3)[row].as_py(), b.column(2)[row].as_py())
                x = np.frombuffer(data, np.uint8)
                h, p, first, last, of = anchors(x, ends)
                hot = np.sort(np.concatenate([_unpack(v["values"], hashes.base(v["r"])) for v in b.column(4)[row].as_py()]))
                t = hashes.short(h)
                keep = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t)
                h, p, first, last, of = (c[keep] for c in (h, p, first, last, of))
                docs = np.array(b.column(1)[row].as_py(), np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                cols = [pa.array(h.view(np.int64)), _slices(x, first, last - first + SPAN), pa.array((p - first).astype(np.int32)), pa.array(docs[of])]
                cols += [pa.array(np.full(len(of), b.column(0)[row].as_py())), pa.array(of.astype(np.int32)), pa.array(first - begin[of])]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "seg", "back", "doc", "block", "i", "pos"])

    return df.select("block", "docs", "ends", "texts", "hot").mapInArrow(run, "h long, seg binary, back int, doc long, block long, i int, pos long")


def least_docs(text: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window start of the text, a row of segments, the least doc of all segments that hold the same 50 bytes at
    a window start; 0 elsewhere."""
    ends = begin + size
    window = np.ones(len(text), bool)
    window[(ends[:, None] - np.arange(1, SPAN)).ravel()] = False
    sa = suffix_array(text, SPAN)
    starts = sa[window[sa]]  # windows within their segment, in the order of suffixes
    of = np.repeat(np.arange(len(begin), dtype=np.int32), size)
    eight = np.ndarray(len(text) - 7, np.uint64, np.ascontiguousarray(text), strides=(1,))  # the eight bytes from each on
    same = np.zeros(len(starts), bool)
    for lo in range(1, len(starts), 200_000):  # adjacent prefixes
        a = starts[lo : lo + 200_000]
        b = starts[lo - 1 : lo - 1 + len(a)]
        left = np.arange(len(a))
        for k in (*range(0, SPAN - 8, 8), SPAN - 8):
            left = left[eight[a[left] + k] == eight[b[left] + k]]
        same[lo + left] = True
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(docs[of[starts]], heads) if len(heads) else np.empty(0, np.int64)
    out = np.zeros(len(text), np.int64)
    out[starts] = np.repeat(least, np.diff(np.append(heads, len(starts))))
    return out


def _solve_rows(t: pa.Table) -> pa.RecordBatch:
    """h, sid and runs of whole anchors (h, sid, doc, seg)."""
    seg = t.column(3).chunk(0)
    offsets = np.frombuffer(seg.buffers()[1], np.int32)[seg.offset : seg.offset + len(seg) + 1].astype(np.int64)
    text = np.frombuffer(seg.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin, size = offsets[:-1] - offsets[0], np.diff(offsets)
    docs = t.column(2).to_numpy()
    found = least_docs(text, begin, size, docs)
    windows = size - SPAN + 1
    first = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(begin)), windows)
    at = np.arange(len(of)) - first[of]
    doc = found[begin[of] + at]
    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(cut[1:], len(of)) - 1
    runs = pa.StructArray.from_arrays([pa.array(at[cut], pa.int32()), pa.array(at[last], pa.int32()), pa.array(doc[cut])], names=["lo", "hi", "doc"])
    ends = np.append(np.searchsorted(of[cut], np.arange(len(begin))), len(cut))
    return pa.RecordBatch.from_arrays([t.column(0).chunk(0), t.column(1).chunk(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], names=["h", "sid", "runs"])


def window_docs(variants: DataFrame) -> DataFrame:
    """h, sid and runs (lo, hi, doc: windows lo to hi were first seen in doc) of variants(h, sid, doc, seg), sorted by h.

    A sort takes whole anchors of about GROUP_BYTES together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole anchors, and the one being read
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and h[0] != held[-1].column(0)[-1].as_py():
                cuts = np.concatenate([[0], cuts])
            size = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False))])
            at = 0
            for c in cuts.tolist():
                if n + size[c] - size[at] >= GROUP_BYTES:
                    part = [*held, b.slice(at, c - at)] if c > at else held
                    if part:
                        yield _solve_rows(pa.Table.from_batches(part).combine_chunks())
                    held, n, at = [], 0, c
            held.append(b.slice(at))
            n += int(size[-1] - size[at])
        if held:
            yield _solve_rows(pa.Table.from_batches(held).combine_chunks())

    return variants.select("h", "sid", "doc", "seg").mapInArrow(run, "h long, sid long, runs array<struct<lo:int,hi:int,doc:bigint>>")


def by_window(variants: DataFrame, scratch: Scratch) -> DataFrame:
    """The same of anchors with very many variants: the least doc of each (anchor, window) is an aggregation."""
    each = variants.select("h", "sid", "doc", "seg", F.explode(F.sequence(F.lit(0), F.octet_length("seg") - SPAN)).alias("k"))
    each = scratch.table(each.select("h", "sid", "doc", "k", F.expr(f"substring(seg, k + 1, {SPAN})").alias("w")), "windows")
    least = scratch.table(each.groupBy("h", "w").agg(F.min("doc").alias("d")), "window-docs")
    run = F.struct(F.col("k").alias("lo"), F.col("k").alias("hi"), F.col("d").alias("doc"))
    return each.join(least, ["h", "w"]).groupBy("h", "sid").agg(F.collect_list(run).alias("runs"))  # at most a segment's windows


def cut_texts(df: DataFrame, with_text: bool) -> DataFrame:
    """doc, digest, n_removed, n_spans, kept_sha256 and kept (null unless with_text) of df(docs, digests, ends, texts, spans)."""
    names = ["doc", "digest", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for row in range(b.num_rows):
                data, ends = _texts(b.column(3)[row].as_py(), b.column(2)[row].as_py())
                begin = np.concatenate([[0], ends[:-1]])
                mark = np.zeros(len(data) + 1, np.int32)
                spans = b.column(4)[row]
                if spans.is_valid:
                    i, s, e = (f.to_numpy() for f in spans.values.flatten())
                    np.add.at(mark, begin[i] + s, 1)
                    np.add.at(mark, begin[i] + e, -1)
                gone = np.cumsum(mark[:-1]) > 0
                x = np.frombuffer(data, np.uint8)
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                head[begin] = gone[begin]
                removed, n_spans = np.add.reduceat(gone, begin, dtype=np.int64), np.add.reduceat(head, begin, dtype=np.int64)
                kept = [x[a:z][~gone[a:z]].tobytes() if n else data[a:z] for a, z, n in zip(begin.tolist(), ends.tolist(), removed.tolist(), strict=True)]
                cols = [b.column(0)[row].as_py(), b.column(1)[row].as_py(), removed, n_spans, [hashlib.sha256(k).hexdigest() for k in kept], kept if with_text else [None] * len(kept)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return df.select("docs", "digests", "ends", "texts", "spans").mapInArrow(run, "doc long, digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def spans_of(seg: DataFrame, s: Scratch) -> DataFrame:
    """block and spans (i, s, e), the covered stretches, of the segments of whole anchors."""
    variants = s.table(seg.groupBy("h", "sid").agg(F.min("doc").alias("doc"), F.first("seg").alias("seg")), "variants")
    counts = s.table(variants.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors-with-variants")
    sorted_ = variants.join(counts.where(F.col("n") <= MANY).select("h"), "h", "left_semi").repartition("h").sortWithinPartitions("h")
    first = [s.table(window_docs(sorted_), "solved")]
    frequent = counts.where(F.col("n") > MANY).select("h")
    if frequent.limit(1).count():
        first.append(s.table(by_window(variants.join(frequent, "h", "left_semi"), s), "solved-by-window"))
    run = F.struct(F.lit(0).alias("lo"), (F.octet_length("seg") - SPAN).cast("int").alias("hi"), F.col("doc").alias("doc"))
    first.append(s.table(variants.join(counts, "h", "left_anti").select("h", "sid", F.array(run).alias("runs")), "alone"))
    s.drop(variants, counts)
    hit = seg.select("doc", "block", "i", "h", "sid", "pos").join(reduce(DataFrame.union, first), ["h", "sid"]).select("doc", "block", "i", "pos", F.explode("runs").alias("r")).where(F.col("r.doc") < F.col("doc"))
    span = F.struct("i", (F.col("pos") + F.col("r.lo")).alias("s"), (F.col("pos") + F.col("r.hi") + SPAN).alias("e"))
    out = s.table(hit.groupBy("block").agg(F.collect_list(span).alias("spans")), "spans")  # at most the block's own segments
    s.drop(*first)
    return out


def cut_blocks(heads: DataFrame, n_bytes: int, scratch: Scratch, with_text: bool) -> DataFrame:
    """What cut_texts returns, of heads(doc, digest, text): different texts of SPAN bytes or more, n_bytes in all."""
    spark, s = heads.sparkSession, scratch
    hashes = Hashes(n_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = s.table(blocks(heads, hashes), "blocks")
    hot = s.table(hot_values(stored.select("block", F.explode("items").alias("x")).select("block", "x.r", "x.values"), hashes), "hot")
    of_block = hot.groupBy("block").agg(F.collect_list(F.struct("r", "values")).alias("hot"))  # at most the block's own anchors
    seg = segments(stored.drop("items").join(of_block.hint("merge"), "block"), hashes).withColumn("sid", F.xxhash64("seg", "back"))
    seg = s.table(seg, "segments")
    s.drop(hot)
    parts = [spans_of(seg.where(F.pmod("h", F.lit(PASSES)) == k), s) for k in range(PASSES)]
    spans = reduce(DataFrame.union, parts).groupBy("block").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    s.drop(seg)
    out = s.table(cut_texts(stored.drop("items").join(spans.hint("merge"), "block", "left"), with_text), "cut")
    s.drop(stored, *parts)
    return out


def remove_repeats(df: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left; null unless with_text) of each row of df(doc_id, text)."""
    s = Scratch(df.sparkSession, "suffix-dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    digest = F.concat(*(F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0")) for seed in (1, 2)))
    docs = df.select(node.alias("doc"), digest.alias("digest"), text.alias("text"))
    short = F.octet_length("text") < SPAN
    keys = s.table(docs.select("doc", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.when(short, F.col("text").cast("binary")).alias("short")), "keys")
    long_ = keys.where(F.col("short").isNull())
    heads = s.table(long_.groupBy("digest").agg(F.min("doc").alias("doc"), F.max("n_bytes").alias("n"), F.count("*").alias("rows")), "heads")
    n_bytes = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = docs.where(~short).join(heads.select("doc", "digest").hint("shuffle_hash"), ["doc", "digest"])
    if long_.join(heads.where("rows > 1").hint("merge"), ["doc", "digest"]).groupBy("digest").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc", "digest"])  # repeated rows
    cut = cut_blocks(texts, n_bytes, s, with_text).withColumnsRenamed({"doc": "d2", "digest": "g2"})
    out = keys.join(cut.hint("merge"), (F.col("doc") == F.col("d2")) & (F.col("digest") == F.col("g2")), "left")
    none = F.lit("").cast("binary")
    gone = F.col("short").isNull() & F.col("d2").isNull()  # an earlier document has the whole text
    pick = lambda whole, plain, found: F.when(gone, whole).when(F.col("short").isNotNull(), plain).otherwise(found)
    return out.select(
        F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", pick(F.col("n_bytes"), F.lit(0), F.col("n_removed")).cast("long").alias("n_removed"), pick(F.lit(1), F.lit(0), F.col("n_spans")).cast("long").alias("n_spans"),
        pick(F.sha2(none, 256), F.sha2("short", 256), F.col("kept_sha256")).alias("kept_sha256"), pick(none, F.col("short"), F.col("kept")).alias("kept"),
    )


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(x, (2 * i + 1)::BIGINT, 100)) AS g FROM (SELECT doc_id, x, unnest(range(greatest(0, len(x) // 2 - 49))) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
hit AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE m < doc_id),
r AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS b FROM hit)),
span AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM r GROUP BY doc_id, k),
piece AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a FROM span),
cut AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (s - a)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS kept, sum(e - s) AS n_removed, count(*) AS n_spans FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
