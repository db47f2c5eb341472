"""Hosts as browsers write them, and sitemaps on tables."""

import random

from pyspark.sql import functions as F

from pagewright.functions import urls as ux
from pagewright.operators import context
from pagewright.sources import fetch, robots

KNOWN = {
    "http://EXAMPLE.com": "http://example.com/",
    "http://bücher.example/x": "http://xn--bcher-kva.example/x",
    "http://BÜCHER.example": "http://xn--bcher-kva.example/",
    "http://日本語。jp/": "http://xn--wgv71a119e.jp/",
    "http://www.ex%41mple.com/": "http://www.example.com/",
    "http://b%C3%BCcher.example/": "http://xn--bcher-kva.example/",
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://2130706433/a": "http://127.0.0.1/a",
    "http://0177.0.0.0x1/": "http://127.0.0.1/",
    "http://1.2.3.": "http://1.2.0.3/",
    "http://256.1.1.1/": "",
    "http://1.2.3.4.5/": "",
    "http://99999999999/": "",
    "http://a.0x/": "",
    "http://a b.com/": "",
    "http://%zz.com/": "",
    "http:\\\\a.com\\b?c\\d": "http://a.com/b?c\\d",
    "http://u:p@a.com/": "http://u:p@a.com/",
    "http://u:@a.com/": "http://u@a.com/",
    "http://@a.com/": "http://a.com/",
    "https://x.com:443/": "https://x.com/",
    "http://a_b.com/": "http://a_b.com/",
    "mailto:a@b.com": "",
}


def test_known_hosts(spark):
    got = spark.createDataFrame([(u,) for u in KNOWN], "u string").select("u", ux.normalize_url(F.col("u")).alias("n"), ux.normalize_url(ux.normalize_url(F.col("u"))).alias("again"), ux.host_of(F.col("u")).alias("h"), ux.site_of(F.col("u")).alias("s")).collect()
    assert {r["u"]: r["n"] for r in got} == KNOWN and all(r["n"] == r["again"] for r in got)
    by = {r["u"]: r for r in got}
    assert by["http://www.ex%41mple.com/"]["s"] == "example.com" and by["http:\\\\a.com\\b?c\\d"]["s"] == by["http://u:p@a.com/"]["h"] == "a.com"


def test_names_in_ascii(spark):
    rng = random.Random(5)
    pools = ["abcxyz019-", "äöüßéñ", "日本語中文字", "абвгд", "🎉😀", "ελληνικά"]
    labels = {"".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 30))) for _ in range(300)}
    labels = sorted(x.lower() for x in labels if any(ord(c) > 127 for c in x))
    got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", ux.host_of(F.concat(F.lit("http://"), "l", F.lit(".com/"))).alias("h")).collect()
    assert {r["l"]: r["h"] for r in got} == {x: "xn--" + x.encode("punycode").decode() + ".com" for x in labels}


def test_links_meet_pages_across_spellings(spark):
    link = lambda u: [(u, u, False)]
    rows = [("bücher.example", "https://bücher.example/a", link("https://xn--bcher-kva.example/b")), ("x", "https://xn--bcher-kva.example/b", link("https://B%C3%BCcher.example/a")), ("x", "https://other.example/", [])]
    pages = spark.createDataFrame(rows, "site string, url string, links array<struct<href:string,resolved:string,nofollow:boolean>>").withColumn("site", ux.site_of(F.col("url")))
    got = {r["url"]: r["inbound_links"] for r in context.with_inbound(pages).collect()}
    assert got == {"https://bücher.example/a": 1, "https://xn--bcher-kva.example/b": 1, "https://other.example/": 0}


def test_sitemaps_on_tables(spark):
    index = lambda *us: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in us) + "</sitemapindex>"
    pages = lambda *us: "".join(f"<loc> {u} </loc>" for u in us)
    files = {"r1": index("a", "r2", "gone"), "r2": pages("https://x.com/7", "https://x.com/3", "https://o.com/1", "https://x.com/8"), "a": index("b", "r1"), "b": pages("https://X.com/9", "https://x.com/3"), "z": pages("https://x.com/1"), "e": ""}
    table = spark.createDataFrame(list(files.items()), "url string, body string")
    seen = []

    def fetched(frontier, n):
        got = robots.from_table(table)(frontier, n).persist()
        seen.extend(r["url"] for r in got.orderBy("o").collect())
        return got

    listed, counters = robots.expand_sitemaps(spark, fetched, ["r1", "z", "r1", "e"], ["x.com"])
    assert [r["url"] for r in listed.orderBy("ordinal").collect()] == ["https://x.com/1", "https://x.com/7", "https://x.com/3", "https://x.com/8", "https://X.com/9"]
    assert counters == {"sitemaps": 5, "asked": 7, "indexes": 2, "entries": 6} and seen == ["r1", "z", "e", "a", "r2", "gone", "b"]
    wide = spark.range(300).select(F.concat(F.lit("w"), "id").alias("url"), F.concat(F.lit("<loc>https://x.com/w"), "id", F.lit("</loc>")).alias("body")).unionByName(spark.createDataFrame([("top", index(*(f"w{k}" for k in range(300))))], "url string, body string"))
    listed, counters = robots.expand_sitemaps(spark, robots.from_table(wide), ["top"], ["x.com"])
    assert counters["asked"] == 50 and [r["url"] for r in listed.orderBy("ordinal").collect()] == [f"https://x.com/w{k}" for k in range(49)]
    assert robots.expand_sitemaps(spark, robots.from_table(table), ["nowhere"], ["x.com"])[1] == {"sitemaps": 0, "asked": 1, "indexes": 0, "entries": 0}


def test_a_folder_as_a_site(spark):
    files = spark.createDataFrame([("index.html", "h"), ("a/index.html", "ai"), ("b.html", "b"), ("robots.txt", "r"), ("myindex.html", "m")], "name string, body string")
    got = {r["url"].removeprefix(fetch.LOCAL_ORIGIN): r["body"] for r in fetch.local_site(files).collect()}
    assert got == {"/index.html": "h", "/": "h", "/a/index.html": "ai", "/a/": "ai", "/b.html": "b", "/b": "b", "/robots.txt": "r", "/myindex.html": "m", "/myindex": "m"}
