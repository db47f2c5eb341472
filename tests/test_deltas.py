"""Views kept by deltas against views made again from all verdicts."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import deltas, priority, scoring
from pagewright.operators.checks import CHECKS, VALUES, check_id

SCHEMA = "site string, page_id long, url string, check_id string, value string"


def table(spark, rows):
    return spark.createDataFrame([(s, p, f"u{p}", c, v) for (s, p, c), v in rows.items()], SCHEMA)


def seen(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def same(views, verdicts):
    matrix = scoring.check_matrix(verdicts, ["site"])
    counts = [F.col(c).cast("long").alias(c) for c in ("pass", "fail", "na", "needs_review")]
    assert seen(views.check_matrix(), "site", "check_id", *counts) == seen(matrix, "site", "check_id", *counts)
    assert seen(views.scores(), "page_id", "score", "bucket") == seen(scoring.page_scores(verdicts, ["site", "page_id", "url"]), "page_id", "score", "bucket")
    ranked = ["site", "check_id", "fail_pct", "priority", "bucket", "rank"]
    assert seen(views.ranked, *ranked) == seen(priority.priority_rows(matrix, ["site"]), *ranked)


@pytest.fixture
def write(spark, tmp_path):
    def f(df, name):
        path = f"file://{tmp_path}/{random.randrange(10**9)}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return f


def test_folding_equals_recomputing(spark, write):
    rng = random.Random(2)
    rows = {(f"s{p % 3}", p, check_id(n)): rng.choice(VALUES) for p in range(9) for n, *_ in CHECKS}
    views = deltas.Views.of(table(spark, rows)).written(write)
    same(views, table(spark, rows))
    changed = {k: rng.choice(VALUES) for k in rng.sample(sorted(rows), 40) if k[0] != "s1"}
    judged = spark.createDataFrame([(s, p, f"u{p}", c, rows[s, p, c], v) for (s, p, c), v in changed.items()], "site string, page_id long, url string, check_id string, heuristic_value string, value string")
    delta = write(deltas.judgement_deltas(judged), "delta")
    assert delta.count() == 2 * sum(rows[k] != v for k, v in changed.items())
    after = views.apply(delta).written(write)
    same(after, table(spark, rows | changed))
    # the opposite takes it back
    same(after.apply(delta.withColumn("sign", -F.col("sign"))).written(write), table(spark, rows))


def test_pages_come_and_go(spark, write):
    rows = {("a", 1, check_id(n)): "FAIL" for n, *_ in CHECKS} | {("b", 2, check_id(1)): "PASS"}
    new = {("a", 3, check_id(n)): "NEEDS_REVIEW" for n, *_ in CHECKS} | {("c", 4, check_id(7)): "FAIL"}
    gone = {k: v for k, v in rows.items() if k[0] == "b"}
    views = deltas.Views.of(table(spark, rows)).written(write)
    delta = deltas.signed(table(spark, new)).union(deltas.signed(table(spark, gone), -1))
    same(views.apply(delta).written(write), table(spark, {k: v for k, v in (rows | new).items() if k not in gone}))
    assert views.scores().where("page_id = 1").first()["score"] == 100 - views.points.where("page_id = 1").first()["lost"] == 3.0


def test_nothing_changed(spark, write):
    empty = spark.createDataFrame([], "site string, page_id long, url string, check_id string, value string, sign int")
    rows = {(None, 1, check_id(1)): "PASS", ("a", None, check_id(2)): "FAIL"}
    views = deltas.Views.of(table(spark, rows)).written(write)
    assert seen(views.apply(empty).points, "site", "page_id", "n", "lost") == seen(views.points, "site", "page_id", "n", "lost")
    assert deltas.Views.of(table(spark, rows).limit(0)).scores().count() == 0
