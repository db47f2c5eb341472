"""The corpus pipeline: every stage, and the whole run, against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import mixing, packing
from pagewright.llm.quality import AdaptiveRules
from tests.llm.conftest import DOCS
from tests.llm.test_operators import WORD, components, plain_line_dedup, plain_quality, shingles


def counts_of(text):
    t = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = plain_quality(t)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": sum(bool(WORD.search(x)) for x in t.split("\n")), "n_upper": sum("A" <= x <= "Z" for x in t), "n_bang": t.count("!")}


def plain_quality_kept(rows):
    """Whether each row passes: the base rule, and fences from quantiles of logarithmic buckets."""
    rules = AdaptiveRules()
    g = (1 + rules.alpha) / (1 - rules.alpha)
    found = [counts_of(r[1]) for r in rows]
    passes = [x["n_words"] >= rules.min_words and 100 * x["n_repeat_words"] <= rules.max_repeat_percent * x["n_words"] for x in found]
    sketch = defaultdict(list)
    for r, x, ok in zip(rows, found, passes, strict=True):
        for m, (a, b, only_above, _) in rules.metrics.items():
            v = x[a] / x[b] if x[b] else 0
            if ok and (v > 0 or not only_above):
                for key in ((m, r[2], r[3]), (m, r[2]), (m,)):
                    sketch[key].append(math.ceil(math.log(v) / math.log(g)) if v > 0 else -(10**6))

    def fence(m, lang, source):
        key = next(k for k in ((m, lang, source), (m, lang), (m,)) if len(sketch[k]) >= rules.support or len(k) == 1)
        if not sketch[key]:
            return math.inf
        s = sorted(sketch[key])
        q1, q3 = (0.0 if b == -(10**6) else 2 * g**b / (g + 1) for b in (s[math.ceil(q * len(s)) - 1] for q in (0.25, 0.75)))
        return q3 + rules.spread * (q3 - q1)

    return [ok and all(x[a] <= fence(m, r[2], r[3]) * x[b] + few for m, (a, b, _, few) in rules.metrics.items()) for r, x, ok in zip(rows, found, passes, strict=True)]


@pytest.fixture(scope="module")
def table(corpus, words):
    """The corpus, a banner on many sites, texts that lose every line, junk, and rows without ids."""
    rng = random.Random(21)
    rows = [(*r[:4], r[0] or 0) for r in corpus]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    banner = " ".join(words[:60])
    for k in range(260):
        rows.append((10_000 + k, f"{text(70)}\n{banner}\n{text(20)}", "en", f"s{k % 14}", k))
    rows += [(20_000 + k, banner, "en", f"s{k}", k) for k in range(4)]
    rows += [(30_000 + k, " ".join(w + "###" for w in text(80).split()), "en", "s1", k) for k in range(5)]
    rows += [(None, text(90), "en", "s2", 1), (None, text(95), "en", "s2", 2), rows[300], rows[300]]
    return rows


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, table, tmp_path):
    docs = spark.createDataFrame(table, DOCS).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]

    def hand_on(name, rows):
        out = stage[name](spark, spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        return rows_of(out)

    kept = hand_on("quality", table)
    assert Counter(kept) == Counter(r for r, ok in zip(table, plain_quality_kept(table), strict=True) if ok)
    assert 0 < len(kept) < len(table) and not any(r[0] and r[0] >= 30_000 for r in kept)

    lines = hand_on("line_dedup", kept)
    left = plain_line_dedup(kept)
    want = [(r[0], left[r[0], r[1]], *r[2:]) for r in kept]
    want = [w for w, r in zip(want, kept, strict=True) if w[1] == r[1] or WORD.search(w[1] or "")]
    assert Counter(lines) == Counter(want) and len(want) < len(kept)

    near = hand_on("near_dedup", lines)
    nodes = {(r[0] is None, r[0] or 0, r[1]): shingles(r[1]) for r in lines}
    groups = defaultdict(list)
    for node, group in components(nodes).items():
        groups[group].append(node)
    assert Counter((r[0] is None, r[0] or 0) for r in near) == Counter(min(g)[:2] for g in groups.values())
    assert {(r[0], r[1]) for r in near} <= {(r[0], r[1]) for r in lines} and len(near) == len(groups) < len(lines)

    mixed = hand_on("mixing", near)
    drawn = {(r["doc_id"], r["size"]): r for r in mixing.mix(spark.createDataFrame(near, DOCS)).collect()}
    assert Counter((r[0], len(WORD.findall(r[1] or ""))) for r in mixed) == Counter(k for k, r in drawn.items() for _ in r["draws"])
    assert set(mixed) <= set(near)
    size = defaultdict(int)
    for r in mixed:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    for r in drawn.values():
        assert abs(size[r["source"]] - r["target"]) < 31_000  # the longest text

    packed = stage["packing"](spark, spark.createDataFrame(mixed, DOCS), str(tmp_path)).collect()
    enc = packing.ByteLevelIds(packing.tokenizer_file())
    lengths = Counter()
    for r in mixed:
        lengths.update((r[0], k, n) for k, (_, n) in enumerate(packing.cut(len(enc.encode(r[1] or "")) // 4 + 1, 1024)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == lengths
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
