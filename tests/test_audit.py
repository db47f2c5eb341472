"""Extraction, checks, scoring, priorities, comparison and judging on authored pages."""

import math

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.functions import urls as ux
from pagewright.operators import compare, judge, priority, rules, scoring, urlsets
from pagewright.operators.checks import check_rows, checks_table
from pagewright.operators.context import link_edges, site_languages, with_context
from pagewright.operators.extract import segments, snapshot

FULL = """<html lang="EN"><head><title>T &amp;amp; x</title><meta name="robots" content="noindex, max-snippet: 0"><meta property="og:image" content="https://a.b/i.png"><meta name="description" content="d1"><meta name="description" content="d2">
<link rel="canonical" href="/c"><link rel=alternate hreflang=de href=/de>
<script type="application/ld+json">{"@graph":[{"@type":["Article"],"headline":"H","author":{"name":"A B"},"datePublished":"2020-01-01","image":""}]}</script>
<script type="application/ld+json">nope{</script><script type='application/ld+json'>null</script></head>
<body><nav><img src=logo.png></nav><h1>One &#233;&#x1F600;</h1><h2>More</h2><h2> </h2><h2>7</h2><h5>five</h5>
<img src="data:x" alt=""><img data-src='/a/b.png?x=1' width=700 height="40%"><a href="../x y?q#f" rel="nofollow ugc">here</a><a>no target</a>
<form method=POST><input id=a><label for="a">L</label><input type=hidden><label>in<textarea></textarea></label><select aria-label="k"></select><button aria-label="go">Go</button></form><ul><li>x<ol><li>y</ol></ul><table></table></body></html>"""


def page(spark, html, url="https://Ex.com/a/b/c/d", status=200):
    return spark.createDataFrame([(1, url, html, "ex.com", status, "h")], "page_id long, url string, html string, site string, status int, hash string")


@pytest.fixture(scope="module")
def full(spark):
    return snapshot(page(spark, FULL)).drop("json_ld").first()


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_snapshot(full):
    assert (full.title, full.lang, full.meta_robots, full.canonical, full.og_image, full.meta_description) == ("T &amp; x", "en", "noindex, max-snippet: 0", "/c", "https://a.b/i.png", "d2")
    assert [(h.level, h.text) for h in full.headings] == [(1, "One é😀"), (2, "More"), (2, "7"), (5, "five")]
    assert full.h1 == ["One é😀"] and full.h2 == ["More", "7"]
    assert [tuple(x) for x in full.hreflang] == [("de", "/de")]
    assert [(x.href, x.resolved, x.text, x.nofollow) for x in full.links] == [("../x y?q#f", "https://ex.com/a/b/x%20y?q#f", "here", True)]
    nav, inline, lazy = full.images
    assert nav.in_chrome and not inline.in_chrome and nav.alt_missing and nav.resolved == "https://ex.com/a/b/c/logo.png"
    assert inline.src_empty and inline.decorative and not inline.alt_missing
    assert lazy.src == "/a/b.png?x=1" and lazy.filename == "b.png" and lazy.width == 700 and lazy.height is None
    assert full.ld_types == ["Article"] and full.ld_dates == ["datePublished=2020-01-01"]
    assert full.controls == 3 and full.unlabeled_fields == 1  # a wrapping label does not count
    assert full.forms[0].method == "post" and full.buttons[0].aria_label == "go"
    assert full.list_count == 1 and full.table_count == 1


FULL_CASES = [(FULL, n, want, "https://ex.com/a/b/c/d") for n, want in [(5, "FAIL"), (6, "FAIL"), (7, "PASS"), (8, "N/A"), (9, "PASS"), (10, "PASS"), (11, "N/A"), (14, "FAIL"), (16, "FAIL"), (17, "FAIL"), (18, "FAIL"), (19, "FAIL"), (20, "NEEDS_REVIEW"), (21, "PASS"), (25, "PASS"), (26, "PASS"), (31, "FAIL"), (34, "PASS"), (35, "NEEDS_REVIEW")]]


def ld(x):
    return f'<script type="application/ld+json">{x}</script><body>x</body>'


EDGE_CASES = [
    (html, n, want, "https://ex.com/a")
    for html, n, want in [
        (ld('{"@type":"Article","author":"","headline":"h"}'), 26, "FAIL"),
        (ld('[{"@type":"WebPage"},{"@type":"Product","name":"n","image":["i"]}]'), 26, "PASS"),
        (ld('{"@type":"VideoObject"}'), 24, "PASS"),
        (ld('{"@type":"FAQPage"}'), 27, "FAIL"),
        (ld('{"@type":"WebPage","image":0}'), 21, "FAIL"),
        (ld('{"@type":"WebPage","image":{}}'), 21, "PASS"),
        ("<body>" + "<a href=/x>here</a>" * 2 + "<a href=/y>good text</a>" * 3, 16, "FAIL"),
        ("<body>" + "<a href=/x>here</a>" + "<a href=/y>good text</a>" * 4, 16, "NEEDS_REVIEW"),
        ("<body>" + "<a href=/x>here</a>" + "<a href=/y>good text</a>" * 5, 16, "PASS"),
        ("<body>" + "<input>" * 2 + "<input aria-label=x>" * 4, 31, "PASS"),
        ("<body>" + "<input>" * 3 + "<input aria-label=x>" * 4, 31, "FAIL"),
        ("<body>" + "<input>" + "<input aria-label=x>" * 4, 31, "FAIL"),
        ("<body>" + "<img src=/a.png>" + "<img src=/a.png alt=t>" * 9, 19, "FAIL"),
        ("<body>" + "<img src=/a.png>" + "<img src=/a.png alt=t>" * 10, 19, "NEEDS_REVIEW"),
        ("<body><img src=/a.png width=95 height=200>", 19, "N/A"),
        ("<body><img src=/a.png width=96 height=96>", 19, "FAIL"),
        ("<body><img src=/img_12.png alt=t>", 22, "FAIL"),
        ("<body><img src=/a.png width=600 height=300 alt=t>", 23, "NEEDS_REVIEW"),
        ("<body>" + "x" * 601, 13, "FAIL"),
        ("<body><h1>a</h1>" + "x" * 598, 13, "PASS"),
        ("<body>" + "x" * 199 + "<i>" * 700, 32, "FAIL"),
        ("<body>" + "x" * 200 + "<i>" * 700, 32, "PASS"),
        ("<body><div style='position: fixed'>cookie</div>", 30, "NEEDS_REVIEW"),
        ("<body>" + "One two. " * 5, 8, "PASS"),
        ("<body>" + ("W" + " w" * 28 + ". ") * 5, 8, "NEEDS_REVIEW"),
        ("<body>" + ("W" + " w" * 36 + ". ") * 5, 8, "FAIL"),
        ("<body>Published on: 2024 x", 10, "PASS"),
        ("<body>Updated 2024 x", 11, "PASS"),
    ]
]

URL_CASES = [("<body>x</body>", n, want, url) for url, n, want in [("https://ex.com/privacy-x", 33, "NEEDS_REVIEW"), ("https://legal.ex.com/", 33, "NEEDS_REVIEW"), ("https://ex.com/services/x", 36, "NEEDS_REVIEW"), ("https://ex.com/servicesx", 36, "N/A"), ("https://ex.com/a/b", 17, "N/A"), ("https://ex.com/a/b/c", 17, "FAIL"), ("https://ex.com/blog/x", 12, "NEEDS_REVIEW"), ("https://ex.com/x", 12, "N/A")]]


def test_verdicts(spark):
    """All cases in one table, each a site of its own."""
    cases = FULL_CASES + EDGE_CASES + URL_CASES
    df = spark.createDataFrame([(k, url, html, f"s{k}", 200, "h") for k, (html, _, _, url) in enumerate(cases)], "page_id long, url string, html string, site string, status int, hash string")
    got = {r.page_id: r for r in rules.wide_verdicts(with_context(snapshot(df)), ["page_id"]).collect()}
    wrong = [(html[:80], url, n, want, got[k][f"C{n:03d}"]) for k, (html, n, want, url) in enumerate(cases) if got[k][f"C{n:03d}"] != want]
    assert wrong == []


def test_every_page_has_36_verdicts_whatever_it_is(spark):
    data = [(1, "https://a.com/", None), (2, "not a url", ""), (3, "https://a.com/x", "<" * 1000), (4, "https://a.com/y", "<script>unclosed"), (5, "https://a.com/z", "&#99999999; &#x0;")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"site": F.lit("a.com"), "status": F.lit(None).cast("int"), "hash": F.lit("h")})
    v = rules.verdicts(with_context(snapshot(df)), ["page_id"], with_evidence=True)
    got = v.collect()
    assert len(got) == 5 * 36 and {r.value for r in got} <= {"PASS", "FAIL", "N/A", "NEEDS_REVIEW"}
    assert all((r.na_reason == "not_applicable") == (r.value == "N/A") for r in got)


def test_text_functions(spark):
    lit = lambda s: F.lit(s)
    assert one(spark, tx.decode_entities(lit("&amp;lt; &#65;&#x42;&nbsp;&#128512;"))) == "< AB 😀"
    assert one(spark, tx.utf16_length(lit("a😀"))) == 3
    assert one(spark, tx.strip_tags(lit("<p>a </p>﻿b"))) == "a b"
    assert one(spark, tx.sentence_count(lit("A b. C d! e f? G"))) == 3
    assert one(spark, tx.body_only(lit("<body a>x<body>y</body>z</body>w"))) == "x<body>y</body>z"
    assert one(spark, tx.visible_text(lit("a<script>b</script>c<style>d"))) == "a cd".replace("cd", "c d")


def test_urls(spark):
    lit = F.lit
    n = lambda u: one(spark, ux.normalize_url(lit(u)))
    assert [n(u) for u in ("HTTP://Ex.com:80", "https://ex.com:8443/a?b#c", "https://ex.com/für", "mailto:x", "https://ex.com/a/../b/./c")] == ["http://ex.com/", "https://ex.com:8443/a?b", "https://ex.com/f%C3%BCr", "", "https://ex.com/b/c"]
    r = lambda h: one(spark, ux.resolve_url(lit(h), lit("https://ex.com/a/b?c")))
    assert [r(h) for h in ("d", "/d", "?e", "#f", "//o.com/x", "../d", "mailto:a@b")] == ["https://ex.com/a/d", "https://ex.com/d", "https://ex.com/a/b?e", "https://ex.com/a/b?c#f", "https://o.com/x", "https://ex.com/d", "mailto:a@b"]
    assert one(spark, ux.site_of(lit("WWW.Ex.com/x"))) == "ex.com"
    assert one(spark, ux.is_www_alias(lit("www.ex.com"), lit("EX.com"))) and not one(spark, ux.is_www_alias(lit("ex.com"), lit("ex.com")))
    assert one(spark, ux.host_aliases(lit("ex.com"), lit("www.ex.com"))) == ["ex.com", "www.ex.com"] and one(spark, ux.host_aliases(lit("ex.com"), lit("o.com"))) == ["ex.com"]
    assert one(spark, ux.url_depth(lit("https://ex.com//a/b/"))) == 2 and one(spark, ux.filename_of(lit("/a/b.png?x/y"))) == "b.png"


def test_context(spark):
    data = [(1, "https://ex.com/", '<title>A</title><body><h1>H</h1><a href="/de/x">x</a><a href="/b">b</a>'), (2, "https://ex.com/b", "<title>a </title><body><h1>h</h1>"), (3, "https://ex.com/c", "<body>"), (4, "https://ex.com/d", "<body><a href=/fr/y>y</a>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"site": F.lit("ex.com"), "status": F.lit(200), "hash": F.lit("h")})
    snap = snapshot(df)
    got = {r.page_id: r for r in with_context(snap).collect()}
    assert [got[k].competing for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert [got[k].inbound_links for k in (1, 2, 3)] == [0, 1, 0] and all(r.in_sitemap and r.multilingual for r in got.values())
    assert link_edges(snap).count() == 3 and site_languages(snap).first().languages == 2
    seg = spark.createDataFrame([("a<nav>b</nav>c<footer>d</footer>e",)], "x string").select(F.explode(segments(F.col("x"))).alias("s")).select("s.*").collect()
    assert [(r.html, r.in_chrome) for r in seg] == [("a", False), ("<nav>b</nav>", True), ("c", False), ("<footer>d</footer>", True), ("e", False)]


def matrix(spark, **counts):
    rows = [("s", r[0], *counts.get(r[0], (0, 0, 0, 0))) for r in check_rows()]
    return spark.createDataFrame(rows, "site string, check_id string, pass long, fail long, na long, needs_review long")


def test_priority(spark):
    m = matrix(spark, C008=(55, 45, 0, 0), C009=(15, 85, 0, 0), C001=(0, 5, 9, 9), C022=(9, 1, 0, 0), C010=(0, 0, 7, 0))
    rows = {r.check_id: r for r in priority.priority_rows(m, ["site"]).collect()}
    assert len(rows) == 35 and "C029" not in rows
    assert (rows["C008"].priority, rows["C009"].priority, rows["C001"].priority, rows["C022"].priority) == (math.floor(45 * 0.7 + 0.5), math.floor(85 * 0.7 + 0.5), 100, 5)
    assert rows["C010"].fail_pct is None and rows["C010"].priority == 0 and rows["C010"].bucket == "NONE" and rows["C001"].rank == 1
    ranked = priority.dividers(priority.priority_rows(m, ["site"]), ["site"]).orderBy("rank").collect()
    assert [r.bucket for r in ranked if r.starts_bucket] == ["HIGH", "MEDIUM", "LOW", "NONE"]
    assert {r.bucket: r.checks for r in priority.priority_bucket_counts(priority.priority_rows(m, ["site"]), ["site"]).collect()} == {"HIGH": 2, "MEDIUM": 1, "LOW": 1, "NONE": 31}


def test_scores(spark):
    v = spark.createDataFrame([("s", "u", "C001", "FAIL"), ("s", "u", "C002", "FAIL"), ("s", "u", "C003", "NEEDS_REVIEW"), ("s", "w", "C001", "PASS")] + [("s", "x", r[0], "FAIL") for r in check_rows()], "site string, url string, check_id string, value string")
    got = {r.url: r for r in scoring.page_scores(v, ["site", "url"]).collect()}
    assert (got["u"].score, got["u"].bucket, got["w"].score, got["x"].score, got["x"].bucket) == (90.5, "average", 100.0, 3.0, "very_bad")
    s = scoring.site_summary(scoring.page_scores(v, ["site", "url"])).first()
    assert s.pages == 3 and s.average_score == 64.5 and scoring.check_matrix(v, []).count() == 36
    assert {r.bucket: r.pages for r in scoring.bucket_counts(scoring.page_scores(v, ["site", "url"]), ["site"]).collect()} == {"high": 1, "average": 1, "low": 0, "bad": 0, "very_bad": 1}


def test_compare(spark):
    data = [(s, f"{s}{k}", "C007", "FAIL" if k < f else "PASS") for s, n, f in (("t", 10, 6), ("c", 10, 5), ("d", 9, 9)) for k in range(n)]
    v = spark.createDataFrame(data, "site string, url string, check_id string, value string")
    pairs = spark.createDataFrame([("t", "c"), ("t", "d")], "target string, competitor string")
    got = compare.compare_sites(compare.fail_rates(v), pairs)
    at = {(r.competitor, r.check_id): r for r in got.collect()}
    assert len(at) == 72 and at["c", "C007"].confidence == "normal" and at["d", "C007"].confidence == "low" and at["c", "C001"].target_rate == 0
    assert [r.competitor for r in compare.worse(got).collect()] == []  # 0.6 - 0.5 lies below 0.1 in doubles
    assert [r.competitor for r in compare.better(got).collect()] == ["d"] and [r.competitor for r in compare.warnings(got).collect()] == ["d"]


def test_judge(spark):
    v = spark.createDataFrame([("a", f"C{k:03d}", x, "old") for k, x in enumerate(["NEEDS_REVIEW"] * 5 + ["FAIL"], 1)], "hash string, check_id string, value string, evidence string")
    j = spark.createDataFrame([("a", "C001", "PASS", "", "0.8", None), ("a", "C002", "NEEDS_REVIEW", "hm", "x", None), ("a", "C003", None, None, None, "boom"), ("a", "C005", "FAIL", "new", "high", None), ("a", "C006", "PASS", "no", "1", None)], "hash string, check_id string, value string, evidence string, confidence string, error string")
    out = judge.apply_judgements(v, j)
    got = {r.check_id: (r.value, r.evidence, r.judged_by, r.confidence, r.outcome) for r in out.collect()}
    assert got == {
        "C001": ("PASS", "old", "judge", 0.8, "judged"),
        "C002": ("NEEDS_REVIEW", "hm", "judge", None, "unchanged"),
        "C003": ("NEEDS_REVIEW", "judge failed: boom", None, None, "failed"),
        "C004": ("NEEDS_REVIEW", "old (judge inconclusive)", "judge", None, "unchanged"),
        "C005": ("FAIL", "new", "judge", None, "judged"),
        "C006": ("FAIL", "old", None, None, None),
    }
    assert tuple(judge.tallies(out).first()) == (2, 1, 2, 3)

    def opinion(row):
        if row["check_id"] == "C002":
            raise ValueError("bad")
        return {"value": "PASS", "confidence": 0.5} if row["check_id"] == "C001" else None

    asked = {r.check_id: (r.value, r.error) for r in judge.invoke_judge(v.where("value = 'NEEDS_REVIEW'"), opinion).collect()}
    assert asked["C001"] == ("PASS", None) and asked["C002"] == (None, "bad") and asked["C003"] == (None, None)


def test_url_sets(spark):
    pages = spark.createDataFrame([(k, f"https://ex.com/{k}") for k in range(60)], "page_id long, url string")
    a, b = (sorted(r.page_id for r in urlsets.sample_pages(p, 10).collect()) for p in (pages, pages.repartition(7)))
    assert a == b and len(a) == 10
    tree = spark.createDataFrame([("s", "u1", "r1", 200)], "site string, url string, first_seen string, first_status int")
    run = spark.createDataFrame([("s", "u1", "r2", 404), ("s", "u2", "r2", 404), ("s", "u2", "r3", 200)], "site string, url string, run_id string, status int")
    assert sorted(map(tuple, urlsets.merge_url_tree(tree, run).collect())) == [("s", "u1", "r1", 200), ("s", "u2", "r2", 404)]
    c = spark.createDataFrame([("t", "a.com", 0)], "target string, competitor string, ordinal int")
    assert [tuple(r) for r in urlsets.add_competitors(c, "t", ["www.A.com", "b.com", "B.com"]).orderBy("ordinal").collect()][0] == ("t", "a.com", 0)
    assert [r.competitor for r in urlsets.add_competitors(c, "t", ["www.A.com", "b.com", "B.com"]).orderBy("ordinal").collect()] == ["a.com", "b.com"]
    canon = spark.createDataFrame([(1, "https://ex.com/a", "https://ex.com/x#1"), (2, "https://ex.com/x", ""), (3, "bad", "")], "page_id long, url string, canonical string")
    assert [(r.canonical_key, r.page_id, r.copies) for r in urlsets.dedupe_canonical(canon).collect()] == [("https://ex.com/x", 1, 2)]


def test_dimension(spark):
    rows = checks_table(spark).collect()
    count = lambda f, v: sum(r[f] == v for r in rows)
    assert len(rows) == 36 and (count("severity", "Critical"), count("severity", "High"), count("severity", "Low")) == (2, 11, 3)
    assert (count("mode", "deterministic"), count("mode", "heuristic")) == (9, 17) and [r.check_id for r in rows if r.excluded] == ["C029"] and sorted(rules.RULES) == list(range(1, 37))
