"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import resampling
from pagewright.llm.words import Segment, Words, blocks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def plain(docs, targets, percent=5, min_words=20, buckets=10_000, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[0]))
    for text in targets:
        t.update(map(bucket, features(text)[0]))
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        f, n = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def target(spark, words):
    rng = random.Random(31)
    texts = [" ".join(rng.choice(words[:200]) for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None, "", "É ñ-9z Zz"]
    return texts, spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def test_against_brute_force(docs, corpus, target):
    texts, table = target
    assert rows(resampling.resample(docs, table, percent=30)) == plain([r[:2] for r in corpus], texts, percent=30)


def test_ranks_over_several_ranges(spark, docs, corpus, target, monkeypatch):
    texts, table = target
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    assert rows(resampling.resample(docs, table, percent=60, min_words=3)) == plain([r[:2] for r in corpus], texts, percent=60, min_words=3)
    same = [(4, "a b c d e " * 5)] * 9 + [(None, "a b c d e " * 5)] * 5 + [(1, "x y " * 20)]
    df = spark.createDataFrame(same, "doc_id long, text string")
    assert rows(resampling.resample(df, table, percent=50)) == plain(same, texts, percent=50)


def test_few_buckets_empty_target_and_empty_table(docs, corpus, none, target):
    texts, table = target
    assert rows(resampling.resample(docs, table.limit(0), buckets=7)) == plain([r[:2] for r in corpus], [], buckets=7)
    assert resampling.resample(none, table).count() == 0


def test_long_texts_are_cut_without_a_trace():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abZ9é") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 400))) for _ in range(20)] + ["x" * 5000 + " end", "--", "", None]
    data = [None if t is None else t.encode() for t in texts]
    for most in (1, 7, 100, 3000, 1 << 22):
        got = np.zeros(len(texts), np.int64)
        counts = np.zeros(97, np.int64)
        for block in blocks(data, 2, most):
            trie = resampling.WordTrie(block)
            np.add.at(got, [s.row for s in block], trie.sums(np.ones(97, np.int64))[0])
            counts += trie.bucket_counts(97)
        assert got.tolist() == [len(features(t)[0]) for t in texts]
        want = Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t)[0])
        assert counts.tolist() == [want[b] for b in range(97)]


def test_crc_states():
    rng = random.Random(4)
    a = [rng.randbytes(rng.randint(0, 30)) for _ in range(300)]
    b = [rng.randbytes(rng.choice([0, 1, 2, 3, 17, 255, 256, 70_000])) for _ in range(300)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert resampling.extend(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_words():
    w = Words.of([Segment(0, "Ab aB--9é\x7f日".encode()), Segment(1, b""), Segment(2, b"ab")])
    assert [w.vocabulary.to_pylist()[i].decode() for i in w.ids] == ["ab", "ab", "9é", "日", "ab"] and w.segment.tolist() == [0, 0, 0, 0, 2]
