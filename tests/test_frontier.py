"""Crawls of many sites as a stream: order, pauses, restarts."""

from collections import Counter

import pytest

from pagewright.sources import crawl, fetch
from pagewright.streaming.frontier import FrontierStream

SITES = {
    "a.com": {"/": "c b a b", "/a": "d / e", "/b": "f c", "/c": "g a", "/d": "h", "/f": "i j"},
    "b.org": {"/": "x y z", "/x": "y2", "/y": "x2 x2 y2", "/z": "/ q"},
    "c.net": {"/": ""},
}


def page(links):
    return "<body>" + "".join(f'<a href="/{x.strip("/")}">{x}</a>' for x in links.split()) + '<a href="/skip" rel=nofollow>n</a><a href="https://else.where/">o</a>'


@pytest.fixture(scope="module")
def archive(spark):
    rows = [(f"https://{s}{p}", 200, f"https://{s}{p}", page(x)) for s, ps in SITES.items() for p, x in ps.items()]
    return spark.createDataFrame(rows, "url string, status int, final_url string, body string").persist()


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(s, f"https://{s}/#top", 0, [s]) for s in SITES] + [("c.net", "no url", 1, ["c.net"]), ("b.org", "https://b.org/", 2, ["b.org"])], "site string, url string, ordinal int, hosts array<string>")


def order(pages):
    out = {}
    for r in sorted(pages.collect(), key=lambda r: r["ordinal"]):
        out.setdefault(r["site"], []).append((r["url"], r["status"], r["depth"]))
    return out


def by_crawl(spark, archive, tmp_path, **options):
    out = {}
    for s in ("b.org",):  # the others by a plain queue
        write = lambda df, name, s=s: (df.write.parquet(f"file://{tmp_path}/{s}-{name}"), spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{s}-{name}"))[1]
        c = crawl.crawl(spark, f"https://{s}", lambda urls: fetch.fetch_from_table(urls, archive), write, **options)
        out[s] = [(r["url"], r["status"], r["depth"]) for r in c.pages.orderBy("ordinal").collect()]
    return out


def plain(limit=200, depth=2):
    """One queue for each site, a page at a time."""
    out = {}
    for s, pages in SITES.items():
        queue, seen, done = [("/", 0)], {"/"}, []
        while queue and len(done) < limit:
            path, d = queue.pop(0)
            done.append((f"https://{s}{path}", 200 if path in pages else 404, d))
            for x in pages.get(path, "").split() if d < depth else []:
                to = "/" + x.strip("/")
                if to not in seen and len(done) + len(queue) < limit:
                    seen.add(to)
                    queue.append((to, d + 1))
        out[s] = done
    return out


def test_order_is_that_of_a_crawl(spark, archive, seeds, tmp_path):
    stream = FrontierStream(spark, f"file://{tmp_path}/s", lambda urls: fetch.fetch_from_table(urls, archive), limit=6, wave=2, pause=0.05)
    stream.seed(seeds)
    got = order(stream.run(300))
    assert got == plain(6) and {"b.org": got["b.org"]} == by_crawl(spark, archive, tmp_path, limit=6)
    assert stream.unfinished() == 0


def test_a_restart_fetches_nothing_twice(spark, archive, seeds, tmp_path):
    asked, waves = Counter(), []

    def get(urls):
        waves.append(urls.count())
        if len(waves) == 3:
            raise ConnectionError("the line is down")
        asked.update(r["url"] for r in urls.collect())
        return fetch.fetch_from_table(urls, archive)

    folder = f"file://{tmp_path}/s"
    first = FrontierStream(spark, folder, get, wave=2)
    first.seed(seeds)
    with pytest.raises(Exception, match="the line is down"):
        first.run(300)
    assert first.unfinished() > 0
    before = set(asked)
    again = FrontierStream(spark, folder, get, wave=2)
    again.seed(seeds)
    assert order(again.run(300)) == plain()
    assert set(asked.values()) == {1} and len(asked) > len(before) > 0
