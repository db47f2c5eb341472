"""Site-wide checks on streams against the batch audit, in several orders."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions.urls import site_of, url_hash
from pagewright.operators.context import with_context
from pagewright.operators.extract import snapshot
from pagewright.operators.rules import verdicts
from pagewright.streaming import site_checks


def page(title, links="", head=""):
    return f"<html><head><title>{title}</title>{head}</head><body><h1>{title}</h1>" + "".join(f'<a href="{x}">{x}</a>' for x in links.split()) + "</body></html>"


ALTERNATE = '<link rel="alternate" hreflang="de" href="/de/x">'
PAGES = [
    ("https://a.com/", page("Home", "/one /two /en/x")),
    ("https://a.com/one", page("Same", "/two")),
    ("https://a.com/two", page(" same ", "/")),
    ("https://www.a.com/three", page("SAME")),
    ("https://a.com/four", page("Alone", "/fr/y /four")),
    ("https://a.com/five#x", page("Five", "/five")),
    ("https://a.com/six", "<body>no title</body>"),
    ("https://a.com/seven", "<body>no title</body>"),
    ("https://b.com/", page("Home", "https://a.com/one")),
    ("https://b.com/x", page("X", "/en/1 /en/2")),
    ("https://c.com/", page("C", "", ALTERNATE)),
    ("https://c.com/d", page("D", "/")),
    ("https://c.com/", page("C again", "", ALTERNATE)),
]


def batch(spark):
    df = spark.createDataFrame(PAGES, "url string, html string")
    snap = snapshot(df.withColumns({"site": site_of(F.col("url")), "hash": url_hash(F.col("url")), "status": F.lit(200)}))
    return {(r["url"], r["check_id"], r["value"]) for r in verdicts(with_context(snap), ["url"]).where("check_id in ('C003', 'C004', 'C034')").collect()}


@pytest.mark.parametrize("seed", [1])
def test_any_order_ends_like_the_batch_audit(spark, tmp_path, seed):
    rows = list(PAGES)
    random.Random(seed).shuffle(rows)
    src, sink, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    schema = "url string, html string"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    site_checks.site_checks_stream(read(), sink, cp).awaitTermination(300)
    said = spark.read.parquet(f"{sink}/*")
    got = {(r["url"], r["check_id"], r["value"]) for r in site_checks.settled(said).collect()}
    assert got == batch(spark)
    # pages that had the other value first were corrected, and nothing is said twice of the same page but corrections
    assert said.where("url is not null").count() > said.select("site", "url", "check_id").where("url is not null").distinct().count()
    # a batch that runs again changes nothing
    assert {(r["url"], r["check_id"], r["value"]) for r in site_checks.settled(said.union(said)).collect()} == got


def test_state_holds_one_url_of_a_title(spark, tmp_path):
    rows = [(f"https://a.com/{k}", "<title>T</title><h1>T</h1>") for k in range(3000)]
    src, sink, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, "url string, html string").coalesce(1).write.mode("append").parquet(src)
    site_checks.site_checks_stream(spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(src), sink, cp).awaitTermination(300)
    assert site_checks.settled(spark.read.parquet(f"{sink}/*")).where("check_id = 'C003' and value = 'FAIL'").count() == 3000
    state = spark.read.format("statestore").option("stateVarName", "url").load(cp)
    assert state.where("key.scope = 'title'").count() == 1
