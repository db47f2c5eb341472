"""Near-duplicates: MinHash with banding, signature and full-set verification, star-based connected components.

Texts with equal shingle sets are one class, found by a 128-bit digest, so copies are never paired. A class has
`bands * rows` universal (multiply-shift) hash minima. In each bucket of a band, every class is compared with one
representative: first by signature, then on the full sets. Buckets whose members then lie in several components are
gone through again: what lies outside the bucket's largest component, its rest, meets that component and itself, in
blocks of `BLOCK` members each. Pairs across components whose sizes and signatures allow the similarity are compared on
their full sets inside the block, the likeliest first, until a link joins their components. A pair is looked at in the
first band whose minima it shares. So no pair that shares a bucket and could join two components is left out, members
that a representative already joins never meet each other, and a task emits at most one link for each member.

A pair at similarity 0.75 meets in a bucket with probability 0.99998 (40 bands of 5 minima).

Defined results: a text without words, empty or null, has no shingles and links with nothing; rows with one doc_id
and one text are one node, so different texts under one doc_id, or under none, are linked and kept each for itself.
A component shows its least doc_id, null only if none of its rows has one; of nodes under that doc_id the one with the
least text hash is kept. Very long texts are shingled whole. Ties between representatives go by a hash of the id.
Other columns, whatever their names, are not looked at; one_of_each_group hands them on. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, documents, packed, unpacked
from pagewright.llm.components import connected_components

WORDS_EACH = 5
PERCENT = 75
BANDS, ROWS = 40, 5
#: Share of equal minima under which a pair is not looked at further; five standard deviations below 0.75.
LEAST_ESTIMATE = 0.6
BLOCK = 1024
#: Up to so many ids, the documents to verify are picked by a broadcast list, beyond that by a shuffle.
BROADCAST_IDS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, known: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the 5-word shingles of a text; with fewer words, the sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(WORDS_EACH, len(words))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h *= MULTIPLIER
        h += w[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


class Minima:
    """bands * rows minima of multiply-shift hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**64, bands * rows, np.uint64, endpoint=False)[:, None] | np.uint64(1)
        self.b = rng.integers(0, 2**64, bands * rows, np.uint64, endpoint=False)[:, None]
        self.mix = rng.integers(0, 2**64, (bands, rows), np.uint64, endpoint=False) | np.uint64(1)
        self.salt = rng.integers(0, 2**64, bands, np.uint64, endpoint=False)

    def signature(self, x: np.ndarray) -> np.ndarray:
        least = None
        for i in range(0, len(x), 512):
            part = self.a * x[None, i : i + 512]
            part += self.b
            m = part.min(axis=1)
            least = m if least is None else np.minimum(least, m, out=least)
        return least >> np.uint64(32)

    def keys(self, sig: np.ndarray) -> np.ndarray:
        h = (sig.reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64) + self.salt
        h ^= h >> np.uint64(31)
        h *= MULTIPLIER
        return h.view(np.int64)


def add_signatures(df: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th, n, dg, sig and keys of df(doc_id, th, text): set size, set digest, 32-bit minima, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known, minima = WordHashes(), Minima(bands, rows)
        for b in batches:
            n, dg, sig, keys = [], [], [], []
            for t in b.column(2):
                x = shingle_hashes(t.as_py(), known)
                n.append(len(x))
                if len(x):
                    s = minima.signature(x)
                    dg.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    sig.append(s.astype(np.uint32).tobytes())
                    keys.append(minima.keys(s))
                else:
                    dg.append(None)
                    sig.append(None)
                    keys.append(np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(dg, pa.binary()), pa.array(sig, pa.binary()), listed], names=["doc_id", "th", "n", "dg", "sig", "keys"])

    return df.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, dg binary, sig binary, keys array<long>")


def add_sets(df: DataFrame) -> DataFrame:
    """id and xs, the full shingle set, of df(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle_hashes(t.as_py(), known).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "xs"])

    return df.select("id", "text").mapInArrow(run, "id long, xs array<long>")


def _sizes_allow(a, b):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def _estimate_filter(pairs: DataFrame) -> DataFrame:
    """u, v of the rows of pairs(u, v, su, sv) whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                su, sv = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
                ok = pa.array((su == sv).mean(axis=1) >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of equal first three columns, of batches sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        head = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(head[:, lo])
            if key != last and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(b.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


class Block:
    """The members (key, i, j, band, mine, id, n, comp, sig, ...) of one bucket, or of two blocks i < j of a large one."""

    def __init__(self, t: pa.Table, bands: int):
        col = lambda k: t.column(k).to_numpy().astype(np.int64)
        self.m, self.i, self.j, self.band = t.num_rows, t.column(1)[0].as_py(), t.column(2)[0].as_py(), t.column(3)[0].as_py()
        self.mine, self.id, self.n, self.comp = col(4), col(5), col(6), col(7)
        self.sig = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint32).reshape(self.m, bands, -1)

    def partners(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Later members of other components that may link with x, and the estimates. A pair is looked at in the first
        band that it shares, and of pairs of blocks only where its members lie in both."""
        rest = slice(x + 1, self.m)
        ok = (self.comp[rest] != self.comp[x]) & (100 * np.minimum(self.n[rest], self.n[x]) >= PERCENT * np.maximum(self.n[rest], self.n[x]))
        if self.i != self.j:
            ok &= self.mine[rest] != self.mine[x]
        at = np.flatnonzero(ok) + x + 1
        if not len(at):
            return at, np.empty(0)
        same = self.sig[at] == self.sig[x]
        estimate = same.mean(axis=(1, 2))
        ok = (estimate >= LEAST_ESTIMATE) & (same.all(axis=2).argmax(axis=1) == self.band)
        return at[ok], estimate[ok]


def _open_members(members: DataFrame, bands: int) -> DataFrame:
    """Of members sorted by (key, i, j), those with a pair that is still open: key, i, j, mine, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches):
            if t.num_rows < 2:
                continue
            g = Block(t, bands)
            if (g.comp == g.comp[0]).all():
                continue
            open_ = np.zeros(g.m, bool)
            for x in range(g.m - 1):
                at, _ = g.partners(x)
                if len(at):
                    open_[x] = True
                    open_[at] = True
            if open_.any():
                yield from t.filter(pa.array(open_)).select([0, 1, 2, 4, 5]).combine_chunks().to_batches()

    return members.mapInArrow(run, "key long, i int, j int, mine int, id long")


def _block_links(members: DataFrame, bands: int) -> DataFrame:
    """u, v: links that join components within a group, confirmed on the full sets (the last column of members).

    Each member meets its partners from the likeliest on, but only those that no link has joined to it yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches):
            g = Block(t, bands)
            xs = t.column(9).combine_chunks()
            starts, flat = xs.offsets.to_numpy(), xs.values.to_numpy().view(np.uint64)
            sets = [flat[starts[k] : starts[k + 1]] for k in range(g.m)]
            root = {int(c): int(c) for c in g.comp}

            def find(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            u, v = [], []
            for x in range(g.m - 1):
                at, estimate = g.partners(x)
                for y in at[np.argsort(-estimate, kind="stable")]:
                    a, b = find(int(g.comp[x])), find(int(g.comp[y]))
                    if a == b:
                        continue
                    sx, sy = sets[x], sets[y]
                    at_y = np.searchsorted(sy, sx)
                    both = int((sy[np.minimum(at_y, len(sy) - 1)] == sx).sum())
                    if 100 * both >= PERCENT * (len(sx) + len(sy) - both):
                        root[max(a, b)] = min(a, b)
                        u.append(int(min(g.id[x], g.id[y])))
                        v.append(int(max(g.id[x], g.id[y])))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return members.mapInArrow(run, "u long, v long")


class NearDuplicates:
    """One run over df(doc_id, text)."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.scratch = Scratch(self.spark, "near-dedup")
        self.docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """id and xs of the ids, a written table."""
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        if self.doubled:  # the rows that stand for classes
            picks = self.picks.join(wanted, "id", "left_semi")
            texts = self.docs.join(picks, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("id", "text").dropDuplicates(["id"])
        else:
            texts = self.docs.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
        return self.scratch.table(add_sets(texts), "sets")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The rows of pairs(u, v), a written table, that the full sets confirm."""
        ids = self.scratch.table(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
        sets = self.full_sets(ids)
        a, b = sets.select(F.col("id").alias("u"), F.col("xs").alias("x")), sets.select(F.col("id").alias("v"), F.col("xs").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        confirmed = pairs.join(a, "u").join(b, "v").where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("u", "v")
        out = self.scratch.table(confirmed, name)
        self.scratch.drop(sets, ids)
        return out

    def run(self) -> DataFrame:
        s, scratch = self.scratch, self.scratch
        sigs = s.table(add_signatures(self.docs), "signatures")
        node = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")  # the least has a doc_id where any has
        classes = s.table(sigs.where("n > 0").groupBy("dg").agg(F.min(node).alias("x"), F.count("*").alias("copies")).select("dg", F.col("x.doc_id").alias("id"), "x.th", "copies"), "classes")
        self.doubled = self.docs.select(F.count("*") != F.count_distinct("doc_id")).first()[0]
        if self.doubled:  # a doc_id may be null or stand for several classes: they get numbers of their own
            classes = s.table(classes.withColumnRenamed("id", "doc_id").withColumn("id", F.monotonically_increasing_id()), "numbered-classes")
            self.picks = classes.select("id", F.col("doc_id").alias("d2"), F.col("th").alias("t2"))
            same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))
            heads = sigs.where("n > 0").join(self.picks, same).select("id", "n", "sig", "keys").dropDuplicates(["id"])
        else:
            heads = sigs.withColumnRenamed("doc_id", "id").join(classes.select("id", "th", "dg"), ["id", "th", "dg"]).select("id", "n", "sig", "keys")
        heads = s.table(heads, "heads")
        members = s.table(heads.select("id", "n", F.posexplode("keys").alias("band", "key")), "members")
        # one representative for each bucket of several classes
        stars = s.table(members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id"), F.col("n"))).alias("r"), F.count("*").alias("m")).where("m > 1").select("key", "m", F.col("r.id").alias("rep"), F.col("r.n").alias("rn")), "stars")
        in_stars = members.join(stars, "key")
        star_pairs = in_stars.where((F.col("id") != F.col("rep")) & _sizes_allow(F.col("n"), F.col("rn"))).select(F.least("id", "rep").alias("u"), F.greatest("id", "rep").alias("v")).distinct()
        by_sig = heads.select("id", "sig")
        signed = star_pairs.join(by_sig.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u").join(by_sig.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
        tested = s.table(_estimate_filter(signed), "star-pairs")
        links = self.verify(tested, "star-links")
        comps = connected_components(links, scratch)
        # buckets that still hold several components, in blocks
        with_comp = members.join(stars.select("key", "m"), "key").join(comps.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id"))
        with_comp = s.table(with_comp.select("key", "m", "band", "id", "n", "comp"), "open-members")
        open_keys = with_comp.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
        opened = s.table(with_comp.join(open_keys, "key", "left_semi").drop("m"), "opened")
        sizes = opened.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("x"), F.sum("k").alias("m"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        sizes = s.table(sizes.select(F.col("key"), F.col("x.comp").alias("main"), blocks(F.col("x.k")).alias("mains"), blocks(F.col("m") - F.col("x.k")).alias("rests")), "open-keys")
        is_main, h = F.col("comp") == F.col("main"), F.xxhash64("id")
        mine = F.when(is_main, F.pmod(h, F.col("mains"))).otherwise(F.col("mains") + F.pmod(h, F.col("rests"))).cast("int")
        other = F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("rests") - 1))
        left = opened.join(sizes, "key").withColumn("mine", mine).withColumn("other", other)
        left = left.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "band", "mine", "id", "n", "comp").join(by_sig, "id").select("key", "i", "j", "band", "mine", "id", "n", "comp", "sig")
        grouped = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        still = s.table(_open_members(grouped(left), BANDS), "still-open")
        if still.limit(1).count():
            sets = self.full_sets(s.table(still.select("id").distinct(), "open-ids"))
            rows = still.join(opened, ["key", "id"]).join(by_sig, "id").join(sets, "id")
            found = s.table(_block_links(grouped(rows.select("key", "i", "j", "band", "mine", "id", "n", "comp", "sig", "xs")), BANDS).distinct(), "block-links")
            comps = connected_components(comps.union(found), scratch)  # the stars so far stand for their links
        joined = classes.join(comps.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id"))
        if self.doubled:
            least = joined.groupBy("comp").agg(F.min(node).alias("r"))
            joined = joined.select("dg", "comp").join(least, "comp").select("dg", F.col("r.doc_id").alias("comp"), F.col("r.th").alias("ct"))
        else:  # a doc_id tells its text
            joined = joined.select("dg", "comp", F.lit(None).cast("long").alias("ct"))
        named = s.table(joined.withColumnRenamed("dg", "d2"), "named")
        out = sigs.select("doc_id", "th", "n", "dg").join(named, F.col("dg") == F.col("d2"), "left")
        comp = F.when(F.col("d2").isNull(), F.col("doc_id")).otherwise(F.col("comp"))
        kept = F.col("d2").isNull() | (F.col("doc_id").eqNullSafe(F.col("comp")) & F.coalesce(F.col("th") == F.col("ct"), F.lit(True)))
        out = out.select("doc_id", "th", F.col("n").alias("n_shingles"), comp.alias("component_id"), kept.alias("kept"))
        s.drop(heads, members, stars, with_comp, opened, sizes)
        return out


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and kept of each row of df(doc_id, text)."""
    return NearDuplicates(df).run()


def one_of_each_group(df: DataFrame) -> DataFrame:
    """df with one document of each group; of repeated rows of that document, one."""
    kept = near_duplicates(df).where("kept").groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("t2")).agg(F.count("*").alias("n"))
    kept = Scratch(df.sparkSession, "near-dedup-kept").table(kept, "kept")
    marked = packed(df, d=F.col("doc_id"), t=F.xxhash64("text"))
    out = marked.join(kept.select("d2", "t2").hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left_semi")
    return (out.dropDuplicates(["d", "t"]) if kept.where("n > 1").limit(1).count() else out).select(*unpacked(df.columns))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
