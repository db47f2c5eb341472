"""python -m pagewright COMMAND: crawl, analyze, judge, priority, compare, report, competitor, status, checklist, doctor."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from importlib import import_module

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright")
    p.add_argument("--root", default="pagewright-data")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("seed")
    c.add_argument("--limit", type=int, default=200)
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--sitemap-only", action="store_true")
    c.add_argument("--enforce-robots", action="store_true")
    a = sub.add_parser("analyze")
    a.add_argument("site")
    a.add_argument("--all", action="store_true")
    a.add_argument("--urls", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    a.add_argument("--random", type=int, nargs="?", const=25)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--thorough", action="store_true")
    j = sub.add_parser("judge", help="settle open verdicts of the latest analysis with a function: row -> {value, evidence, confidence}")
    j.add_argument("site")
    j.add_argument("--with", dest="judge", required=True, metavar="MODULE:FUNCTION")
    for name in ("priority", "report"):
        r = sub.add_parser(name)
        r.add_argument("site")
        r.add_argument("--run-id")
        r.add_argument("--format", choices=["md", "json", "html"], default="html" if name == "priority" else "md")
        r.add_argument("--competitors", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    m = sub.add_parser("compare")
    m.add_argument("site")
    m.add_argument("--competitors", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    k = sub.add_parser("competitor")
    k.add_argument("site")
    k.add_argument("domains", nargs="+")
    s = sub.add_parser("status")
    s.add_argument("site", nargs="?")
    sub.add_parser("checklist")
    sub.add_parser("doctor")
    return p


def doctor(spark: SparkSession) -> list[tuple[str, bool, str]]:
    """Assertions on the environment: name, whether it holds, what was found."""
    from pagewright.operators.checks import checks_table
    from pagewright.operators.rules import RULES

    java = spark.sparkContext._jvm.System.getProperty("java.version")
    return [
        ("python", sys.version_info >= (3, 10), sys.version.split()[0]),
        ("spark", int(spark.version.split(".")[0]) >= 4, spark.version),
        ("java", int(java.split(".")[0]) >= 17, java),
        ("checks", checks_table(spark).count() == 36, "36 rows"),
        ("rules", sorted(RULES) == list(range(1, 37)), f"{len(RULES)} rules"),
        ("utc", spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"), spark.conf.get("spark.sql.session.timeZone")),
    ]


def _compared(spark, store, site, others):
    from pagewright.operators import compare

    target, parts, skipped = store.read_run("verdicts", site), [], []
    for o in others:
        run = store.read_run("verdicts", o)
        if run is None:
            skipped.append(o)
        else:
            parts.append(run)
    if target is None or not parts:
        return None, skipped
    columns = ["site", "url", "hash", "check_id", "value"]  # judged runs have more
    allv = target.select(*columns)
    for x in parts:
        allv = allv.unionByName(x.select(*columns))
    pairs = spark.createDataFrame([(site, o) for o in others if o not in skipped], "target string, competitor string")
    return compare.compare_sites(compare.fail_rates(allv), pairs), skipped


def _store_scores(store, site: str, run_id: str, v, views):
    """Stores what an analysis comes to: points, matrix, scores and the summary. Gives the scores."""
    from pagewright.operators import scoring

    points = store.write_run("points", site, run_id, views.points)
    matrix = store.write_run("matrix", site, run_id, views.check_matrix())
    scores = store.write_run("scores", site, run_id, replace(views, points=points).scores().withColumnRenamed("page_id", "hash"))
    summary = scoring.site_summary(scores).first()
    top = [{"check_id": r["check_id"], "fail": r["fail"], "needs_review": r["needs_review"]} for r in scoring.top_issues(matrix).collect()]
    residual = v.where("value = 'NEEDS_REVIEW'").count()
    store.write_json(f"analyses/{site}/{run_id}/summary.json", {**(summary.asDict() if summary else {"site": site, "pages": 0}), "residual_review": residual, "top_issues": top})
    store.update_site(site, last_analysis=run_id)
    return scores


def _judge(spark, store, site: str, name: str, run_id: str) -> int:
    """A new analysis from the latest one: open verdicts are judged, and what changes is folded into its scores."""
    from pagewright.operators import deltas, judge, priority, scoring
    from pagewright.operators.checks import checks_table

    v, points, matrix, pages = (store.read_run(k, site) for k in ("verdicts", "points", "matrix", "pages"))
    if v is None or points is None or matrix is None:
        print(f"no analysis of {site}", file=sys.stderr)
        return 1
    module, function = name.split(":")
    dim = F.broadcast(checks_table(spark).select("check_id", "title", "severity"))
    queue = v.where("value = 'NEEDS_REVIEW'").join(dim, "check_id").join(pages.select("hash", "html"), "hash", "left")
    said = store.write_run("judgements", site, run_id, judge.invoke_judge(queue.select("hash", "url", "check_id", "title", "severity", "evidence", "html"), getattr(import_module(module), function)))
    seen = Observation("judge")
    judged = judge.apply_judgements(v.drop(*judge.ADDED), said).observe(seen, *judge.tally_columns())
    new = store.write_run("verdicts", site, run_id, judged)
    points, matrix = points.drop("run_id"), matrix.drop("run_id")
    before = deltas.Views(points, matrix, priority.priority_rows(matrix, ["site"]))
    delta = deltas.judgement_deltas(new.withColumn("page_id", F.col("hash")))
    _store_scores(store, site, run_id, new, before.apply(delta))
    store.write_run("review-queue", site, run_id, scoring.review_queue(new))
    print(seen.get)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from pagewright.functions.urls import site_of
    from pagewright.operators import deltas, examples, scoring
    from pagewright.operators.checks import checks_table
    from pagewright.operators.context import with_context
    from pagewright.operators.extract import snapshot
    from pagewright.operators.rules import verdicts
    from pagewright.operators.urlsets import choose_pages
    from pagewright.plans import reports
    from pagewright.sources import crawl as crawling
    from pagewright.sources import fetch
    from pagewright.sources.store import Store, stamp

    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = args.root if "://" in args.root else "file://" + __import__("os").path.abspath(args.root)
    store = Store(spark, root)
    site_key = lambda s: spark.range(1).select(site_of(F.lit(s))).first()[0]
    if args.command == "checklist":
        for r in checks_table(spark).orderBy("ordinal").collect():
            print(f"{r['check_id']}  {r['severity']:<9} {r['gap_category']:<20} {r['title']}")
        return 0
    if args.command == "doctor":
        found = doctor(spark)
        for name, ok, what in found:
            print(f"{'ok  ' if ok else 'FAIL'} {name}: {what}")
        return int(not all(ok for _, ok, _ in found))
    if args.command == "status":
        for r in store.status(site_key(args.site) if args.site else None):
            print(r)
        return 0
    if args.command == "crawl":
        run_id = stamp()
        if fetch.is_local_seed(args.seed):
            folder = args.seed.removeprefix("file://")
            table = fetch.local_site(fetch.folder_pages(spark, folder))
            table.write.mode("overwrite").parquet(f"{root}/work/{run_id}/folder")
            table = spark.read.schema(table.schema).parquet(f"{root}/work/{run_id}/folder")
            seed, get = fetch.LOCAL_ORIGIN + "/", lambda urls: fetch.fetch_from_table(urls, table)
        else:
            seed, get = args.seed, lambda urls: fetch.fetch(urls, fetch.http_fetcher()).join(urls, "url")

        def write(df, name):
            df.write.mode("overwrite").parquet(f"{root}/work/{run_id}/{name}")
            return spark.read.schema(df.schema).parquet(f"{root}/work/{run_id}/{name}")

        c = crawling.crawl(spark, seed, get, write, args.limit, args.depth, args.sitemap_only, args.enforce_robots, seed_first=not fetch.is_local_seed(args.seed))
        pages = store.write_run("pages", c.site, run_id, c.pages)
        store.extend_url_tree(c.site, pages, run_id)
        store.update_site(c.site, last_crawl=run_id, hosts=c.hosts)
        store.write_json(f"crawl-stats/{c.site}/{run_id}.json", {**c.stats, "warnings": c.warnings, "disallow": c.disallow})
        print(f"{c.site}: {c.stats}", *c.warnings, sep="\n")
        return 0
    site = site_key(args.site)
    if args.command == "competitor":
        print(*store.add_competitors(site, args.domains), sep="\n")
        return 0
    if args.command == "analyze":
        pages = store.read_run("pages", site)
        if pages is None:
            print(f"no crawl of {site}", file=sys.stderr)
            return 1
        run_id = stamp()
        snaps = with_context(snapshot(pages))
        wanted = spark.createDataFrame([(u,) for u in args.urls], "url string") if args.urls else None
        chosen = choose_pages(snaps, args.all, wanted, args.random, args.seed, order="ordinal")
        rivals = examples.duplicate_examples(snaps, "ordinal")
        v = store.write_run("verdicts", site, run_id, examples.name_rivals(verdicts(chosen, ["site", "url", "hash"], with_evidence=True), rivals))
        scores = _store_scores(store, site, run_id, v, deltas.Views.of(v.withColumn("page_id", F.col("hash"))))
        store.write_json(f"analyses/{site}/{run_id}/input.json", {"crawl": store.latest("pages", site), "all": args.all, "urls": args.urls, "random": args.random, "seed": args.seed, "thorough": args.thorough})
        if args.thorough:
            store.write_run("review-queue", site, run_id, scoring.review_queue(v))
        print(scoring.site_summary(scores).first())
        for r in scoring.top_issues(scoring.check_matrix(v, [])).collect():
            print(r["check_id"], "failed", r["fail"], "open", r["needs_review"])
        return 0
    if args.command == "judge":
        return _judge(spark, store, site, args.judge, stamp())
    run_id = getattr(args, "run_id", None)
    v, scores = store.read_run("verdicts", site, run_id), store.read_run("scores", site, run_id)
    if v is None or scores is None:
        print(f"no analysis of {site}", file=sys.stderr)
        return 1
    others = [site_key(c) for c in args.competitors] if args.competitors else store.competitors(site)
    compared, skipped = _compared(spark, store, site, others) if others and args.command != "priority" else (None, [])
    for s in skipped:
        print(f"{s} has no analysis and is left out")
    if args.command == "compare":
        if compared is None:
            print("nothing to compare with", file=sys.stderr)
            return 1
        print(f"{store.root}/comparisons", store.write_run("comparisons", site, stamp(), compared.withColumn("site", F.lit(site))).count())
        return 0
    data = reports.report_data(v, scores, store.url_tree(site), store.latest("review-queue", site) is not None, compared)
    if args.command == "priority":
        rows = reports.priority_data(scoring.check_matrix(v, ["site"]))
        text = reports.html_priority(site, rows, data["coverage"]) if args.format == "html" else reports.json_report(site, {"coverage": data["coverage"], "rows": rows})
        print(f"Rows: {len(rows)}")
    else:
        text = reports.markdown_report(site, data) if args.format == "md" else reports.json_report(site, data)
    print(store.write_text(f"reports/{stamp()}-{site}-{args.command}.{args.format}", text))
    return 0


if __name__ == "__main__":
    sys.exit(main())
