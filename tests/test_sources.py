"""Crawling, storing, reporting, streaming and the command line, on a site folder made here."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.__main__ import main
from pagewright.operators import judge, scoring
from pagewright.plans import reports
from pagewright.sources import crawl, fetch, robots
from pagewright.sources.store import Store, stamp
from pagewright.streaming.pages import first_seen_stream, page_verdicts, score_stream, windowed_failures


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_robots_and_sitemaps(spark):
    r = one(spark, robots.parse_robots(F.lit("# c\nSitemap: https://a/s.xml\nUser-agent: *\nDisallow: /x\r\ndisallow:\n")))
    assert r.sitemaps == ["https://a/s.xml"] and r.disallow == ["/x", ""]
    assert one(spark, robots.parse_sitemap(F.lit("<LOC> u1 </LOC><loc>u2</loc><loc a=1>u3</loc>"))) == ["u1", "u2"]
    assert one(spark, robots.sitemap_kind(F.lit("<sitemapindex>"))) == "index" and one(spark, robots.sitemap_kind(F.lit(""))) == "urlset"


def routes(spark, pages):
    """A getter over {url: (status, final url or None, body)}."""
    table = spark.createDataFrame([(u, s, f or u, b) for u, (s, f, b) in pages.items()], "url string, status int, final_url string, body string")
    return lambda urls: fetch.fetch_from_table(urls, table)


@pytest.fixture
def write(spark, tmp_path):
    def f(df, name):
        df.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{name}")

    return f


A = "https://ex.com"


def test_crawl_follows_links_in_order(spark, write):
    site = {
        f"{A}/": (200, None, '<body><a href="/b">b</a><a href="/a">a</a><a href="/a#x">again</a><a rel=nofollow href="/n">n</a><a href="https://o.com/">o</a>'),
        f"{A}/a": (200, None, '<body><a href="/c">c</a>'),
        f"{A}/b": (200, None, '<body><a href="/d">d</a><a href="/c">c</a>'),
        f"{A}/robots.txt": (200, None, f"Sitemap: {A}/i.xml\nDisallow: /d"),
        f"{A}/i.xml": (200, None, f"<sitemapindex><loc>{A}/s.xml</loc><loc>{A}/gone.xml</loc></sitemapindex>"),
        f"{A}/s.xml": (200, None, f"<loc>{A}/s1</loc><loc>https://o.com/z</loc>"),
        f"{A}/d": (200, None, "<body>d"),
    }
    c = crawl.crawl(spark, A, routes(spark, site), write)
    got = [(r.url.removeprefix(A), r.status, r.depth) for r in c.pages.orderBy("ordinal").collect()]
    assert got == [("/", 200, 0), ("/s1", 404, 0), ("/b", 200, 1), ("/a", 200, 1), ("/d", 200, 2), ("/c", 404, 2)]
    assert c.site == "ex.com" and c.stats["failed"] == 2 and c.stats["sitemap_indexes"] == 1 and c.stats["sitemap_entries"] == 1
    assert {r.status: r.n for r in c.status_counts().collect()} == {200: 4, 404: 2}


def test_crawl_limit_robots_and_aliases(spark, tmp_path, write):
    W = "https://www.ex.com"
    site = {f"{A}/": (200, f"{W}/", '<body><a href="/x">x</a><a href="/y">y</a>'), f"{W}/robots.txt": (200, None, "Disallow: /x")}
    c = crawl.crawl(spark, A, routes(spark, site), write, limit=2, enforce_robots=True)
    # the queue starts at the URL that the seed leads to, with the answer already fetched
    got = c.pages.orderBy("ordinal").collect()
    assert [(r.url, r.status) for r in got] == [(f"{W}/", 200), (f"{W}/y", 404)] and c.stats["redirected_seed"] and c.hosts == ["ex.com", "www.ex.com"] and not c.warnings

    def other(df, name):
        return write(df, "other-" + name)

    c = crawl.crawl(spark, A, routes(spark, {f"{A}/": (200, "https://o.com/", "<body><a href='https://o.com/q'>q</a>")}), other, sitemap_only=False)
    assert c.warnings and c.pages.count() == 1


def test_sitemaps_open_first_in_first_out(spark, write):
    site = {
        f"{A}/": (200, None, "<body>home"),
        f"{A}/robots.txt": (200, None, f"Sitemap: {A}/z.xml\nSitemap: {A}/i.xml\nSitemap: {A}/b.xml"),
        f"{A}/z.xml": (200, None, f"<loc>{A}/z2</loc><loc>{A}/z1</loc><loc>https://o.com/q</loc>"),
        f"{A}/i.xml": (200, None, f"<sitemapindex><loc>{A}/y.xml</loc><loc>{A}/a.xml</loc><loc>{A}/b.xml</loc></sitemapindex>"),
        f"{A}/b.xml": (200, None, f"<loc>{A}/b1</loc><loc>{A}/z1</loc>"),
        f"{A}/y.xml": (200, None, f"<loc>{A}/y1</loc>"),
        f"{A}/a.xml": (200, None, f"<loc>{A}/a1</loc>"),
    }
    get = routes(spark, site)
    order = ["z2", "z1", "b1", "y1", "a1"]
    c = crawl.crawl(spark, A, get, write)
    assert [r.url.removeprefix(A + "/") for r in c.pages.orderBy("ordinal").collect()] == ["", *order]
    assert (c.stats["candidates"], c.stats["fetched"], c.stats["failed"], c.stats["sitemap_entries"], c.stats["sitemap_indexes"]) == (6, 6, 5, 6, 1)
    # what the limit leaves unfetched is a candidate all the same; a local folder puts its home page last
    c = crawl.crawl(spark, A, get, lambda df, name: write(df, "cut-" + name), limit=2, seed_first=False)
    assert [r.url.removeprefix(A + "/") for r in c.pages.orderBy("ordinal").collect()] == order[:2] and c.stats["candidates"] == 6 and c.stats["fetched"] == 2


def test_fetchers_never_raise(spark):
    def fetcher(url):
        if url.endswith("bad"):
            raise TimeoutError("late")
        return 200, url + "/", "text/html", "x"

    got = {r.url: r for r in fetch.fetch(spark.createDataFrame([("http://a/bad",), ("http://a/ok",)], "url string"), fetcher, pause=0, tasks=2).collect()}
    assert got["http://a/bad"].status == 0 and "late" in got["http://a/bad"].error and got["http://a/ok"].redirected
    assert fetch.local_name("https://local.site/") == "index.html" and fetch.local_name("https://local.site/a/b") == "a/b.html" and fetch.is_local_seed("dir") and not fetch.is_local_seed("HTTP://x")


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "site"
    d.mkdir()
    page = "<html lang=en><head><title>{t}</title></head><body><h1>{t}</h1>{b}</body></html>"
    (d / "index.html").write_text(page.format(t="Home", b='<a href="/about">about us</a><a href="blog.html">our blog</a>'))
    (d / "about.html").write_text(page.format(t="About", b="<p>text</p>"))
    (d / "blog.html").write_text(page.format(t="Blog", b="<ul><li>x</ul>"))
    (d / "sitemap.xml").write_text("<urlset><url><loc>https://local.site/about</loc></url></urlset>")
    (d / "robots.txt").write_text("Sitemap: https://local.site/sitemap.xml\n")
    return d


def opinion(row):
    """A judge that the command line finds by its name."""
    assert row["title"] and row["severity"] and "<html" in row["html"]
    if row["check_id"] == "C029":
        raise ValueError("no answer")
    return {"value": "FAIL" if row["check_id"] == "C015" else "PASS", "evidence": "read", "confidence": 0.5} if row["check_id"] != "C028" else None


def _judged(spark, run, root, capsys):
    store = Store(spark, root)
    before, first = {(r["hash"], r["check_id"]): r["value"] for r in store.read_run("verdicts", "local.site").collect()}, store.latest("verdicts", "local.site")
    capsys.readouterr()
    assert run("judge", "local.site", "--with", "tests.test_sources:opinion") == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1].replace("'", '"'))
    v = store.read_run("verdicts", "local.site")
    assert store.latest("verdicts", "local.site") > first
    change = {"C015": "FAIL", "C028": "NEEDS_REVIEW", "C029": "NEEDS_REVIEW"}
    assert {(r["hash"], r["check_id"]): r["value"] for r in v.collect()} == {k: change.get(k[1], "PASS") if x == "NEEDS_REVIEW" else x for k, x in before.items()}
    assert counts == judge.tallies(v).first().asDict() and counts["failed"] and counts["unchanged"] and counts["judged"]
    scores = lambda df: {(r["hash"], r["score"], r["bucket"]) for r in df.collect()}
    assert scores(store.read_run("scores", "local.site")) == scores(scoring.page_scores(v, ["site", "url", "hash"]))
    cells = lambda df: {(r["check_id"], r["pass"], r["fail"], r["na"], r["needs_review"]) for r in df.collect()}
    assert cells(store.read_run("matrix", "local.site")) == cells(scoring.check_matrix(v, ["site"]))
    latest = store.latest("verdicts", "local.site")
    summary = store.read_json(f"analyses/local.site/{latest}/summary.json")
    assert summary["residual_review"] == counts["residual"] == store.read_run("review-queue", "local.site").count() and summary["pages"] == 3
    assert store.read_json(f"analyses/local.site/{first}/input.json")["thorough"] is True


def test_command_line(spark, folder, tmp_path, capsys):
    root = str(tmp_path / "data")
    run = lambda *a: main(["--root", root, *a], spark)
    assert run("crawl", str(folder)) == 0
    assert run("analyze", "local.site", "--thorough") == 0
    assert run("judge", "nobody.com", "--with", "tests.test_sources:opinion") == 1
    _judged(spark, run, f"file://{root}", capsys)
    assert run("priority", "local.site") == 0 and "Rows: 35" in capsys.readouterr().out
    assert run("priority", "local.site", "--format", "json") == 0
    assert run("competitor", "local.site", "www.Other.com") == 0
    assert run("report", "local.site") == 0 and run("report", "local.site", "--format", "json") == 0
    assert run("compare", "local.site") == 1 and run("report", "nobody.com") == 1 and run("analyze", "nobody.com") == 1
    assert run("compare", "local.site", "--competitors", "local.site") == 0
    assert run("status") == 0 and run("checklist") == 0
    store = Store(spark, f"file://{root}")
    assert store.read_run("pages", "local.site").count() == 3 and store.competitors("local.site") == ["other.com"]
    assert store.read_run("verdicts", "local.site").count() == 3 * 36 and store.url_tree("local.site").count() == 3
    assert store.read_json("sites/local.site.json")["last_analysis"] == store.latest("verdicts", "local.site")
    names = store.names("reports")
    text = store.read_text(f"reports/{next(n for n in names if n.endswith('.md'))}")
    assert reports.lint_report(text) == [] and {r["rule"] for r in reports.lint_report("x")} >= {"title", "coverage", "caveats"}
    data = json.loads(store.read_text(f"reports/{next(n for n in names if n.endswith('report.json'))}"))
    assert data["summary"]["pages"] == 3 and len(data["matrix"]) == 36
    page = store.read_text(f"reports/{next(n for n in names if n.endswith('.html'))}")
    assert page.count("<tr>") >= 35 and 'class="divider"' in page


def test_store_is_immutable_and_finds_the_latest(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("u",)], "url string")
    assert s.read_run("pages", "a.com") is None and s.latest("pages", "a.com") is None
    s.write_run("pages", "a.com", "2024-01-01", df)
    s.write_run("pages", "a.com", "2024-01-02", df.union(df))
    assert s.latest("pages", "a.com") == "2024-01-02" and s.read_run("pages", "a.com").count() == 2 and s.read_run("pages", "a.com", "2024-01-01").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        s.write_run("pages", "a.com", "2024-01-01", df)
    s.update_site("a.com", x=1)
    assert s.update_site("a.com", y=2) == {"x": 1, "y": 2, "site": "a.com"}
    assert len(stamp()) == len("2024-01-01T00-00-00-000Z") and ":" not in stamp()


def test_streams(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    rows = [(f"https://ex.com/{k}", "<title>t</title><body><h1>h</h1>", 200) for k in range(4)]
    df = spark.createDataFrame(rows, "url string, html string, status int")
    df.write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    score_stream(read(), out, cp).awaitTermination(120)
    first_seen_stream(read(), out + "-tree", cp + "-tree").awaitTermination(120)
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(out + "-tree/batch=0").count() == 4
    df.union(df).withColumn("url", F.concat("url", F.lit("/new"))).write.mode("append").parquet(src)
    first_seen_stream(read(), out + "-tree", cp + "-tree").awaitTermination(120)
    assert spark.read.parquet(out + "-tree/batch=1").count() == 4
    v = page_verdicts(df)
    assert v.count() == 4 * 36 and v.where("check_id = 'C003' and value = 'NEEDS_REVIEW'").count() == 4
    known = spark.createDataFrame([("https://ex.com/0", True, 2, True, False)], "url string, competing boolean, inbound_links bigint, in_sitemap boolean, multilingual boolean")
    assert {r.value for r in page_verdicts(df, known).where("check_id = 'C003' and url like '%/0'").collect()} == {"FAIL"}
    timed = page_verdicts(df).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert windowed_failures(timed).where("check_id = 'C025'").first().n == 4


def test_key_pages_by_relative_url(spark):
    from pagewright.operators.rules import RULES

    want = {"https://a.com/services/x": 1, "services/x": 1, "./products/": 1, "//h.com/services?x": 1, " /platform#a": 1, "blog/services": 0, "?services": 0, "": 0, "https://a.com/": 0}
    got = spark.createDataFrame([(u,) for u in want], "url string").select("url", RULES[36]()[0].alias("v")).collect()
    assert {r.url: r.v for r in got} == {u: "NEEDS_REVIEW" if n else "N/A" for u, n in want.items()}
