"""Ranked search and its treaps against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import search, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w, Counter(w)) for d, w in held if w]
    n, words = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = Counter()
    for item, text in items:
        q = terms(text)
        scores = []
        for d, w, c in held:
            m = 100 - 75 + (75 * len(w) * n) // words
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        for r, (s, _, _, d) in enumerate(sorted(scores)[:k]):
            out[item, r + 1, d, -s] += 1
    return out


def rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def items(words, corpus):
    rng = random.Random(51)
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(12)]
    out += [(20, corpus[41][1]), (21, corpus[3][1]), (22, corpus[85][1]), (30, None), (31, ""), (32, "zzzzzzzzzz-not-there"), (33, "A b C a a a"), (33, "A b C a a a"), (None, words[5] + " " + words[6]), (34, "É ü 日本語 ONE")]
    return out


@pytest.fixture(scope="module")
def table(spark, items):
    from pyspark.sql import functions as F

    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("terms", "doc_id", "rank", "score")})


def test_against_brute_force(docs, corpus, items, table):
    want = plain([r[:2] for r in corpus], items)
    assert rows(search.rank_documents(docs, table)) == want
    assert {r[0] for r in want} >= {None, 20, 33, 34} and not {30, 31, 32} & {r[0] for r in want}


def test_small_blocks(docs, corpus, items, table, monkeypatch):
    monkeypatch.setattr(search, "ITEM_TERMS", 60)
    monkeypatch.setattr(search, "POSTINGS", 40)
    assert rows(search.rank_documents(docs, table, k=3)) == plain([r[:2] for r in corpus], items, 3)


def test_ties_and_repeated_rows(spark):
    docs = [(d, t) for d in (5, 3, None, 9, 3, None, -4, 12, 7) for t in ("alpha beta", "alpha gamma delta", None, "--")]
    items = [(1, "alpha"), (2, "gamma beta beta")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(search.rank_documents(df.repartition(3), it, k=7)) == plain(docs, items, 7)


def test_empty_tables(spark, docs, none, table):
    assert search.rank_documents(none, table).count() == 0
    assert search.rank_documents(docs, table.limit(0)).count() == 0


def shape(t, root):
    """Checks order and heap of a treap; gives its documents and its depth."""
    out, todo, deepest = [], [(root, -1, 1 << 60, 1 << 62, 1)], 0
    while todo:
        i, low, high, most, depth = todo.pop()
        if i < 0:
            continue
        assert low < t.doc[i] < high and t.impact[i] <= most
        out.append(int(t.doc[i]))
        deepest = max(deepest, depth)
        todo += [(t.left[i], low, t.doc[i], t.impact[i], depth + 1), (t.right[i], t.doc[i], high, t.impact[i], depth + 1)]
    return sorted(out), deepest


def some_treaps(rng, n_docs, n_terms, top):
    held = {t: sorted(rng.sample(range(n_docs), rng.randint(1, n_docs))) for t in range(n_terms)}
    post = [(t, d, rng.randint(1, top)) for t, ds in held.items() for d in ds]
    return post, treaps.InvertedTreaps(*(np.array(x, np.int64) for x in zip(*post, strict=True)))


@pytest.mark.parametrize("top", [1, 5, 10**9])
def test_treaps_and_traversal(top, monkeypatch):
    rng = random.Random(top)
    for n_docs, n_terms in ((1, 1), (50, 3), (400, 8)):
        post, t = some_treaps(rng, n_docs, n_terms, top)
        for term in range(n_terms):
            docs, depth = shape(t, t.root[term])
            assert docs == [d for x, d, _ in post if x == term]
            assert depth <= 12 + 6 * math.log2(len(docs))
        for cells in (1 << 20, 30):
            monkeypatch.setattr(treaps, "CELLS", cells)
            for _ in range(10):
                q = [(x, rng.randint(1, 3)) for x in rng.sample(range(n_terms + 2), rng.randint(1, n_terms))]
                score = Counter()
                for term, d, v in post:
                    score[d] += v * dict(q).get(term, 0)
                want = sorted((-s, d) for d, s in score.items() if s)[:4]
                best = treaps.Best(4)
                ids = np.arange(n_docs) * 10
                treaps.traverse(t, q, ids, np.ones(n_docs, bool), best)
                assert list(zip((-best.score).tolist(), (best.doc // 10).tolist(), strict=True)) == want


def test_traversal_skips_what_cannot_enter():
    rng = np.random.default_rng(3)
    n = 20_000
    term = np.repeat([0, 1, 2], n)
    doc = np.tile(np.arange(n), 3)
    impact = (rng.pareto(1.2, 3 * n) * 1000).astype(np.int64) + 1
    t, best = treaps.InvertedTreaps(term, doc, impact), treaps.Best(10)
    scored = treaps.traverse(t, [(0, 1), (1, 1), (2, 1)], np.arange(n), np.ones(n, bool), best)
    total = impact.reshape(3, n).sum(0)
    assert best.score.tolist() == sorted(total.tolist(), reverse=True)[:10] and scored < n // 20


def test_impacts_stay_whole_numbers():
    assert search.impacts(np.array([3]), np.array([2]), np.array([7]), 5, 100).tolist() == [3 * (2_000_000_000 // (2000 + 8 * (25 + 75 * 7 * 5 // 100)))]
    assert search.weights(np.array([1, 10]), 10).tolist() == [math.floor(1000 * math.log(22 / 3)), math.floor(1000 * math.log(22 / 21))]


def test_parts_hold_every_row():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array([1, 1, 1, 1], pa.int64()), pa.array([b"0000" * k for k in (0, 2_000_000, 1, 3)]), pa.array([b""] * 4)], names=["doc_id", "n", "terms", "times"])
    parts = list(search._parts(iter([b, b])))
    assert [d for p in parts for d in p.column(0).to_pylist()] == [1, 2, 3, 4] * 2 and len(parts) > 2
