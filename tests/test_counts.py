"""Counts on bytes against the same rules as regular expressions, and their cost."""

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import counts
from pagewright.functions import text as tx
from pagewright.plans import registry

ODD = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"]
NEAR = ["\x1c", "\x85", "\u200b", "\u200c", "\u180e", "\u2060", "\u3001", "\xc2", "\u4e00", "\ufefe", "\U0001f600"]
LETTERS = [*"AZaz.!?.@[", "\u0401", "\u0410", "\u042f", "\u0430", "\u040f", "\u0400", "\xc0"]


def plain(text):
    words = re.findall(f"[^{tx.WS_CHARS}]+", text)
    return (1 + len(re.findall(f"[.!?]{tx.WS}+[A-Z\u0410-\u042f\u0401]", text)) if words else 0), len(words)


def test_counts_of_odd_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["", " ", "\u3000", "A", "a. B", "a.", ". A", "A. \ufeff\u0401.", "\u0430!\xa0\u042f? \u0430", "a \x85"]
    texts += ["".join(rng.choice(rng.choice([ODD, NEAR, LETTERS, LETTERS])) for _ in range(rng.randrange(60))) for _ in range(3000)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, text string").repartition(3)
    got = {r["k"]: (r["sentences"], r["words"]) for r in df.select("k", counts.sentence_stats(F.col("text")).alias("s")).select("k", "s.*").collect()}
    assert got.pop(-1) == (None, None) and got == {k: plain(t) for k, t in enumerate(texts)}
    monkeypatch.setattr(counts, "PART_BYTES", 100)
    parts = counts.in_parts(pa.array(["a. B", None, *texts])[2:]).to_pylist()
    assert [(r["sentences"], r["words"]) for r in parts] == [plain(t) for t in texts]
    assert counts.in_parts(pa.array([], pa.string())).to_pylist() == []


def test_statistics_of_documents_take_little_time(spark, tmp_path):
    # 40 MB of words, which regular expressions with a list of matches take minutes for
    text = F.repeat(F.lit("One word and another. More of them, and so on! "), 1600)
    spark.range(0, 500, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["sentence_stats_documents"](spark, str(tmp_path))
    start = time.time()
    assert df.groupBy("sentences", "words", "average_words").count().collect() == [(3200, 16000, 5.0, 500)]
    assert time.time() - start < 15
