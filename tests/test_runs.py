"""Streams of runs: late, repeated and unfinished ones."""

from pyspark.sql import functions as F

from pagewright.sources.store import Store
from pagewright.streaming import runs


def stamp(day, hour=0):
    return f"2024-03-{day:02d}T{hour:02d}-00-00-000Z"


def test_runs_are_handed_on_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = Store(spark, root)
    page = lambda site, k: spark.createDataFrame([(f"https://{site}/{i}", site) for i in range(k)], "url string, site string")
    got = []

    def each(rows, n):
        got.extend((r["site"], r["run_id"], r["n"]) for r in rows.groupBy("site", "run_id").agg(F.count("*").alias("n")).collect())

    go = lambda name, **o: runs.run_stream(spark, root, "pages", f"{root}/cp-{name}", each, **o).awaitTermination(200)
    latest = lambda **o: runs.latest_stream(spark, root, "pages", f"{root}/latest", f"{root}/cp-latest", **o).awaitTermination(200)
    store.write_run("pages", "a.com", stamp(10), page("a.com", 2))
    store.write_run("pages", "b.com", stamp(11), page("b.com", 3))
    go("x")
    latest()
    assert sorted(got) == [("a.com", stamp(10), 2), ("b.com", stamp(11), 3)]
    # a marker written again, an earlier run that comes late, data without a marker, and a marker that names no time
    store.write_text("commits/pages/retry.json", f'{{"site": "a.com", "run_id": "{stamp(10)}", "rows": 2}}\n')
    store.write_run("pages", "b.com", stamp(9), page("b.com", 1))
    page("c.com", 5).drop("site").write.parquet(f"{root}/pages/site=c.com/run_id={stamp(12)}")
    store.write_text("commits/pages/odd.json", '{"site": "a.com", "run_id": "soon", "rows": 1}\n{"site": null, "run_id": "2024-01-01T00-00-00-000Z"}\n')
    go("x")
    latest()
    assert sorted(got) == [("a.com", stamp(10), 2), ("b.com", stamp(9), 1), ("b.com", stamp(11), 3)]
    store.commit("pages", "c.com", stamp(12))
    store.write_run("pages", "a.com", stamp(20), page("a.com", 1))
    go("x")
    latest()
    assert len(got) == 5 and ("c.com", stamp(12), 5) in got
    found = {r["site"]: (r["run_id"], r["runs"]) for r in runs.latest_runs(spark, f"{root}/latest").collect()}
    assert found == {"a.com": (stamp(20), 2), "b.com": (stamp(11), 2), "c.com": (stamp(12), 1)}
    assert {s: x[0] for s, x in found.items()} == {s: store.latest("pages", s) for s in found}


def test_what_is_older_than_the_watermark_is_too_late(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = Store(spark, root)
    mark = lambda day, name: store.write_text(f"commits/pages/{name}.json", f'{{"site": "a.com", "run_id": "{stamp(day)}", "rows": 1}}\n')
    go = lambda: runs.latest_stream(spark, root, "pages", f"{root}/latest", f"{root}/cp", late="2 days").awaitTermination(200)
    for k, day in enumerate((10, 20, 15, 19)):
        mark(day, f"m{k}")
        go()
    r = runs.latest_runs(spark, f"{root}/latest").first()
    assert (r["run_id"], r["runs"]) == (stamp(20), 3)
