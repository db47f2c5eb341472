"""The seeded sample against the whole shuffle, ordinals, and examples from large groups."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import examples, sampling


def whole_shuffle(items, k, seed):
    out, n = list(items), len(items)
    for step, i in enumerate(range(n - 1, 0, -1), 1):
        j = int(sampling.generator(seed, step) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out[:k]


def test_the_generator(spark):
    # the first numbers after seeds 0, 1 and 42, by the generator's definition in 32-bit words
    def by_words(seed):
        a, m = seed & 0xFFFFFFFF, lambda x, y: (x * y) % 2**32
        while True:
            a = (a + 0x6D2B79F5) % 2**32
            t = m(a ^ (a >> 15), a | 1)
            t = t ^ ((t + m(t ^ (t >> 7), t | 61)) % 2**32)
            yield ((t ^ (t >> 14)) % 2**32) / 2**32

    for seed in (0, 1, 42, 2**32 - 1, -5):
        want = by_words(seed)
        numbers = [next(want) for _ in range(50)]
        assert [sampling.generator(seed, k + 1) for k in range(50)] == numbers
        got = spark.range(1, 51).select(sampling.generated(seed, F.col("id")).alias("x")).collect()
        assert [r["x"] for r in got] == numbers
    big = 10_000_000_019
    assert spark.range(big, big + 1).select(sampling.generated(7, F.col("id"))).first()[0] == sampling.generator(7, big)


@pytest.mark.parametrize(("n", "k", "seed"), [(0, 5, 1), (1, 5, 1), (2, 2, 9), (37, 37, 42), (3000, 25, 42)])
def test_places_of_the_shuffle(spark, n, k, seed):
    assert sampling.shuffled_places(spark, n, k, seed) == whole_shuffle(range(n), k, seed)


def test_sample_of_pages_and_ordinals_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 11)
    rng = random.Random(3)
    rows = [(k, f"u{k % 7}", rng.choice([None, k // 9])) for k in range(90)] + [(90, None, 3), (91, "u1", 3), (91, "u1", 3)]
    df = spark.createDataFrame(rows, "page_id int, url string, at int").repartition(5)
    line = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or "", r[0]))
    got = sampling.with_ordinals(df, ["at", "url", "page_id"]).orderBy("ordinal").collect()
    assert [(r["page_id"], r["url"], r["at"]) for r in got] == line and [r["ordinal"] for r in got] == list(range(len(rows)))
    picked = sampling.seeded_sample(df, 20, 7).orderBy("place").collect()
    by_id = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    assert [(r["page_id"], r["url"]) for r in picked] == [r[:2] for r in whole_shuffle(by_id, 20, 7)] and picked[0].asDict().keys() == {"page_id", "url", "at", "place"}
    assert sampling.seeded_sample(df.limit(0)).count() == 0


def test_examples_of_a_large_group(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("page_id"), F.lit("a.com").alias("site"), F.concat(F.lit("https://a.com/"), (n - F.col("id")).cast("string")).alias("url"), F.lit("T").alias("title"), F.array(F.lit("H")).alias("h1"))
    more = spark.createDataFrame([(n, "a.com", "https://a.com/only", "Else", ["x"]), (n + 1, "b.com", "https://b.com/1", "T", ["H"]), (n + 2, "b.com", "https://b.com/1", "t ", ["h"]), (n + 3, "b.com", None, "T", ["H"])], "page_id long, site string, url string, title string, h1 array<string>")
    e = examples.duplicate_examples(df.unionByName(more))
    assert "WindowGroupLimit" in e._jdf.queryExecution().executedPlan().toString()
    assert e.count() == n
    first = [f"https://a.com/{n - k}" for k in range(4)]
    got = {r["url"]: r for r in e.where(F.col("url").isin([*first, "https://a.com/1"])).collect()}
    assert got["https://a.com/1"]["examples"] == first[:3] and got[first[1]]["examples"] == [first[0], first[2], first[3]]
    assert {r["others"] for r in got.values()} == {n - 1}
    v = spark.createDataFrame([("a.com", first[0], "C003", "FAIL", "x"), ("a.com", first[0], "C004", "FAIL", "y"), ("b.com", "https://b.com/1", "C003", "PASS", "z")], "site string, url string, check_id string, value string, evidence string")
    said = {(r["site"], r["check_id"]): r["evidence"] for r in examples.name_rivals(v, e).collect()}
    assert said["a.com", "C003"] == f"same title and main heading on {n - 1} other pages: {', '.join(first[1:4])}" and said["a.com", "C004"] == "y" and said["b.com", "C003"] == "z"


def test_examples_where_urls_come_again(spark):
    # page_id, URL and title: u comes often with one title, and once with another; v comes twice with one
    rows = [(k, "u", "A") for k in range(9)] + [(9, "v", "A"), (10, "w", "A"), (11, "v", "A"), (12, "x", "A"), (13, "u", "B"), (14, "x", "B"), (15, "v", "C"), (16, "y", None)]
    df = spark.createDataFrame([(p, "s.com", u, t, ["H"] if t else None) for p, u, t in rows], "page_id long, site string, url string, title string, h1 array<string>").repartition(3)
    got = {(r["url"], r["signature"]): (r["others"], r["examples"]) for r in examples.duplicate_examples(df).collect()}
    want = {}
    for _, u, t in rows:
        rest = [x for _, x, s in rows if s == t and x != u]
        if t and rest:
            want[u, f"{t.lower()}|h"] = (len(rest), rest[:3])
    assert got == want and got["u", "a|h"] == (4, ["v", "w", "v"]) and got["v", "a|h"] == (11, ["u", "u", "u"])
    v = spark.createDataFrame([("s.com", "u", "C003", "FAIL", "x")], "site string, url string, check_id string, value string, evidence string")
    said = examples.name_rivals(v, examples.duplicate_examples(df)).collect()
    assert [r["evidence"] for r in said] == ["same title and main heading on 4 other pages: v, w, v"]
