"""Polite fetching: schedules in virtual time, real threads, and the data source against a join."""

import random
import threading
import time
from collections import defaultdict

import pytest

from pagewright.sources import fetch, polite


def listing(plan):
    """plan: {host: number of URLs}, hosts mixed as a list has them."""
    rng = random.Random(1)
    rows = [(h, f"http://{h}/{k}") for h, n in plan.items() for k in range(n)]
    rng.shuffle(rows)
    return [(h, u, lambda u=u: polite.answer(u, lambda: (200, u, "", "x"))) for h, u in rows]


@pytest.mark.parametrize("hold", [3, 25, 10_000])
def test_hosts_do_not_wait_for_each_other(hold):
    plan = {"big": 40, **{f"h{k}": 3 for k in range(30)}}
    takes = 0.2
    flights = polite.Virtual(16, lambda key: takes)
    asked = defaultdict(list)
    for at, row in polite.in_turn(listing(plan), flights, 1.0, hold):
        asked[row[0].split("/")[2]].append(at)
    assert {h: len(a) for h, a in asked.items()} == plan
    for times in asked.values():
        assert all(b - a >= 1.0 + takes - 1e-9 for a, b in zip(sorted(times), sorted(times)[1:], strict=False))
    if hold == 10_000:
        assert flights.now() < 40 * 1.2 + 3  # the busiest host alone takes 40 * 1.2


def test_slow_hosts_leave_room_for_others():
    flights = polite.Virtual(2, lambda key: 50.0 if key[0] == "slow" else 0.1)
    order = [row[0].split("/")[2] for _, row in polite.in_turn(listing({"slow": 1, "a": 5, "b": 5}), flights, 0.0)]
    assert order[-1] == "slow" and flights.now() < 51
    assert list(polite.in_turn([], polite.Virtual(1), 1.0)) == []


def test_never_more_in_flight_than_allowed_and_one_for_each_host():
    lock, now, most, both = threading.Lock(), defaultdict(int), [0], [0]

    def ask(h, u):
        with lock:
            now[h] += 1
            most[0], both[0] = max(most[0], sum(now.values())), max(both[0], now[h])
        time.sleep(0.01)
        with lock:
            now[h] -= 1
        if u.endswith("7"):
            raise ConnectionError("gone")
        return 200, u + "#moved", "text/html", "b"

    listed = [(h, f"http://{h}/{k}", lambda h=h, k=k: polite.answer(f"http://{h}/{k}", lambda: ask(h, f"http://{h}/{k}"))) for h in "abcdef" for k in range(10)]
    got = [r for _, r in polite.in_turn(listed, polite.Threads(4), 0.001)]
    assert len(got) == 60 and most[0] == 4 and both[0] == 1
    assert sum(r[3] == 0 and "gone" in r[7] for r in got) == 6 and sum(r[2] for r in got) == 54


def echo():
    """A fetcher that the data source finds by its name."""

    def ask(url):
        if "bad" in url:
            raise TimeoutError("late")
        return 404 if "none" in url else 200, url, "text/html", "body of " + url

    return ask


def rows(df):
    return sorted((r["url"], r["final_url"], r["redirected"], r["status"], r["ok"], r["body"]) for r in df.collect())


def test_source_equals_a_join(spark):
    pages = [(f"https://h{k % 5}.com/{k}", 200 if k % 7 else 500, f"https://h{k % 5}.com/{k}" + "x" * (k % 3 == 0), "b" * k) for k in range(60)]
    archive = spark.createDataFrame(pages, "url string, status int, final_url string, body string")
    listed = archive.selectExpr("*", "'text/html' AS content_type")
    got = polite.polite_fetch(listed.union(listed.limit(9)), polite.REPLAY, pause=2.0, groups=3)
    assert rows(got) == rows(fetch.fetch_from_table(archive.select("url"), archive))
    asked = defaultdict(list)
    for r in got.collect():
        asked[r["url"].split("/")[2]].append(r["asked"])
    assert all(sorted(a) == [2.0 * k for k in range(12)] for a in asked.values())


def test_source_with_a_named_fetcher(spark):
    urls = [("https://a.com/1",), ("https://a.com/bad",), ("https://b.com/none",), (None,), ("no host",), ("https://a.com/1",)]
    got = {r["url"]: r for r in polite.polite_fetch(spark.createDataFrame(urls, "url string"), "tests.test_polite:echo", pause=0.01).collect()}
    assert set(got) == {u for u, in urls if u}
    assert got["https://a.com/bad"]["status"] == 0 and "late" in got["https://a.com/bad"]["error"] and not got["https://b.com/none"]["ok"]
    assert got["no host"]["body"] == "body of no host"
    assert polite.polite_fetch(spark.createDataFrame([], "url string"), "tests.test_polite:echo").count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from pagewright.sources import scratch

    class Conf:
        def get(self, key, default=None):
            return default

    class Elsewhere:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Elsewhere())
