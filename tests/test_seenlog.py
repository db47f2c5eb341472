"""The first-seen log against a plain dictionary, over several runs, retries and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.sources.seenlog import SeenLog, bloom, bucket_of, has_bit, probe

RUN = "site string, url string, status int"


def runs(n):
    rng = random.Random(6)
    out = []
    for k in range(n):
        rows = [(f"s{rng.randrange(3)}", f"u{rng.randrange(60 * (k + 1))}", rng.choice([200, 404])) for _ in range(80)]
        out.append(rows + rows[:5] + [(None, "u", 200), ("s", None, 200)])
    return out


def plain(data):
    seen = {}
    for k, rows in enumerate(data):
        new = {}
        for s, u, status in rows:
            if (s, u) not in seen:
                new[s, u] = min(new.get((s, u), 999), status)
        seen |= {key: (f"r{k}", status) for key, status in new.items()}
    return {(*key, *v) for key, v in seen.items()}


def rows(df):
    got = [tuple(r) for r in df.select("site", "url", "first_seen", "first_status").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_runs_write_only_what_is_new(spark, tmp_path):
    data = runs(5)
    log = SeenLog(spark, f"file://{tmp_path}/log", buckets=8, most=3)
    for k, run in enumerate(data):
        before = log.tree().count()
        n = log.append(spark.createDataFrame(run, RUN), f"r{k}")
        assert rows(log.tree()) == plain(data[: k + 1]) and log.tree().count() == before + n
        if k < 3:
            assert spark.read.parquet(f"{log.path}/delta-r{k}/rows").count() == n
    assert log.append(spark.createDataFrame(data[0], RUN), "again") == 0
    assert log.append(spark.createDataFrame([], RUN), "none") == 0
    assert any(f.startswith("base-") for f in log.manifest["folders"])
    # another reader finds the same log, with the buckets it began with
    other = SeenLog(spark, log.path, buckets=99)
    assert other.buckets == 8 and rows(other.tree()) == plain(data)
    log.clean()
    assert rows(SeenLog(spark, log.path).tree()) == plain(data)
    with pytest.raises(ValueError, match="in the log"):
        log.append(spark.createDataFrame(data[0], RUN), log.manifest["folders"][-1].removeprefix("delta-"))


def test_a_run_that_died_is_written_again(spark, tmp_path, monkeypatch):
    data = runs(2)
    log = SeenLog(spark, f"file://{tmp_path}/log", buckets=4)
    log.append(spark.createDataFrame(data[0], RUN), "r0")

    def die(folders):
        raise ConnectionError("the driver is gone")

    monkeypatch.setattr(log, "_commit", die)
    with pytest.raises(ConnectionError):
        log.append(spark.createDataFrame(data[1], RUN), "r1")
    again = SeenLog(spark, log.path)
    assert rows(again.tree()) == plain(data[:1])
    again.append(spark.createDataFrame(data[1], RUN), "r1")
    assert rows(again.tree()) == plain(data)
    with pytest.raises(Exception, match="(?i)exist"):  # two writers cannot make the same manifest
        stale = SeenLog(spark, log.path)
        stale.manifest["version"] -= 1
        stale._commit([])


def test_filters_know_all_and_claim_little(spark):
    df = spark.range(4000).select(F.lit("s").alias("site"), F.concat(F.lit("u"), "id").alias("url"), "id").withColumn("bucket", bucket_of(2))
    filters = bloom(df.where("id < 2000"))
    hit = F.lit(True)
    for k in range(1, 5):
        hit &= has_bit(F.col("bits"), probe(k))
    got = df.join(filters, "bucket").groupBy(F.col("id") < 2000).agg(F.count_if(hit).alias("n")).collect()
    n = {r[0]: r[1] for r in got}
    assert n[True] == 2000 and n[False] < 40
