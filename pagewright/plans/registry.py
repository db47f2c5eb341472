"""Queries of the audit engine and their DuckDB counterparts, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import counts
from pagewright.functions import text as tx
from pagewright.functions import urls as ux
from pagewright.operators import compare, context, deltas, examples, extract, judge, priority, rules, sampling, scoring, urlsets
from pagewright.operators.checks import CHECKS, check_id, checks_table
from pagewright.plans.audit import audit, page_table
from pagewright.plans.oracle import oracle_queries
from pagewright.sources import fetch, polite, seenlog
from pagewright.sources.scratch import Folder
from pagewright.streaming import runs, site_checks
from pagewright.streaming.frontier import FrontierStream

c = F.col


def _page(f):
    """A query of one expression over pages."""
    return lambda spark, sf: page_table(spark, sf).select("page_id", *f())



def _links(spark, sf):
    pages = page_table(spark, sf)
    return pages.select("page_id", F.posexplode(extract.links(tx.body_only(c("html")))).alias("pos", "l")).select("page_id", "pos", c("l.href").alias("href"), c("l.text").alias("text"), c("l.rel").alias("rel"))


def _links_in_chrome(spark, sf):
    seg = page_table(spark, sf).select("page_id", F.explode(extract.segments(tx.body_only(c("html")))).alias("s"))
    n = seg.select("page_id", "s.in_chrome", F.size(extract.links(c("s.html"))).alias("n"))
    return n.groupBy("page_id").agg(F.sum(F.when(c("in_chrome"), c("n")).otherwise(0)).alias("in_chrome"), F.sum(F.when(~c("in_chrome"), c("n")).otherwise(0)).alias("outside"))


def _averaged(n, w):
    return n.cast("long").alias("sentences"), w.alias("words"), F.when(n > 0, w.cast("double") / n).otherwise(0.0).alias("average_words")


def _sentences(text):
    return _averaged(tx.sentence_count(text), tx.word_count(text))


def _sentence_stats_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", counts.sentence_stats(c("text")).alias("s")).select("doc_id", *_averaged(c("s.sentences"), c("s.words")))


def _headings(spark, sf):
    h = page_table(spark, sf).select("page_id", F.posexplode(extract.headings(tx.body_only(c("html")))).alias("pos", "h"))
    return h.select("page_id", "pos", "h.level", "h.text")


def _dedupe_canonical(spark, sf):
    return urlsets.dedupe_canonical(page_table(spark, sf)).select("canonical_key", "page_id", c("copies").cast("long"))



def _host_filter(spark, sf):
    # the hosts of the smallest page ids: a list a user would give
    first = [r["url"] for r in page_table(spark, sf).orderBy("page_id").limit(5).select("url").collect()]
    return urlsets.host_filter(page_table(spark, sf), [u.split("/")[2] for u in first]).select("page_id", "url")


def _select_urls(spark, sf):
    pages = page_table(spark, sf)
    return urlsets.select_urls(pages, pages.where("page_id % 7 = 0").select(F.concat("url", F.lit("#part")).alias("url"))).select("page_id", "url")


def _www_alias(spark, sf):
    host = ux.host_of(c("url"))
    other = F.when(host.startswith("www."), ux.strip_www(host)).otherwise(F.concat(F.lit("www."), host))
    return page_table(spark, sf).select("page_id", ux.is_www_alias(host, other).alias("is_alias"), ux.is_www_alias(host, host).alias("self_alias"), F.array_join(ux.host_aliases(host, other), ",").alias("aliases"))


def _inbound(spark, sf):
    return context.with_inbound(audit(spark, sf).snapshots).select("page_id", c("inbound_links").cast("long"))


def _targets(spark, sf):
    edges = context.link_edges(audit(spark, sf).snapshots)
    return edges.groupBy("site", "href").agg(F.count("*").alias("n"))


def _sitemap(spark, sf):
    snap = audit(spark, sf).snapshots
    return context.with_sitemap(snap.select("page_id", "site", "url"), snap.where("page_id % 3 = 0").select("site", "url")).select("page_id", "in_sitemap")


def _check(n):
    return lambda spark, sf: audit(spark, sf).wide.select("page_id", c(check_id(n)).alias("value"))


def _matrix(spark, sf):
    return audit(spark, sf).matrix.select("site", "check_id", *(c(x).cast("long") for x in ("pass", "fail", "na", "needs_review")))


def _whole_matrix(spark, sf):
    return scoring.check_matrix(audit(spark, sf).verdicts, [])


def _priority(spark, sf):
    return priority.priority_rows(audit(spark, sf).matrix, ["site"])


def _pairs(spark, sf):
    """Each site against the two sites with the most pages."""
    pages = page_table(spark, sf).groupBy("site").agg(F.count("*").alias("n"))
    top = pages.orderBy(F.desc("n"), "site").limit(2).select(c("site").alias("competitor"))
    return pages.select(c("site").alias("target")).crossJoin(F.broadcast(top)).where("target <> competitor")


def _compared(spark, sf):
    return compare.compare_sites(compare.fail_rates(audit(spark, sf).verdicts), _pairs(spark, sf))


def _url_tree(spark, sf):
    pages = page_table(spark, sf)
    tree = pages.where("page_id % 2 = 0").select("site", "url", F.lit("run1").alias("first_seen"), F.lit(200).alias("first_status"))
    run = pages.select("site", "url", F.lit("run2").alias("run_id"), F.lit(404).alias("status"))
    return urlsets.merge_url_tree(tree.dropDuplicates(["site", "url"]), run)


def _polite_fetch(spark, sf):
    """The whole page table, asked again from its record: what comes back, and when each host would have been asked."""
    pages = page_table(spark, sf)
    listed = pages.groupBy("url").agg(F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.min_by("html", "page_id").alias("body")).withColumn("final_url", c("url"))
    got = polite.polite_fetch(listed, polite.REPLAY, pause=0.25, hold=1_000_000)
    return got.select("url", "status", "ok", "redirected", F.coalesce(F.length("body"), F.lit(0)).cast("long").alias("body_length"), F.round(c("asked") * 1000).cast("long").alias("asked_ms"))


def _streamed_crawl(spark, sf):
    """Every site of the page table crawled from its first page, two links deep, with the table as the web."""
    pages = page_table(spark, sf).withColumn("url", ux.normalize_url(c("url"))).where("url <> ''")
    archive = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("body"), F.lit(200).alias("status")).withColumn("final_url", c("url"))
    seeds = pages.groupBy("site").agg(F.min_by("url", "page_id").alias("url")).select("site", "url", F.lit(0).alias("ordinal"), F.array(ux.host_of(c("url"))).alias("hosts"))
    stream = FrontierStream(spark, Folder(spark, "streamed-crawl").path, lambda urls: fetch.fetch_from_table(urls, archive), limit=100_000, wave=100_000)
    stream.seed(seeds)
    return stream.run().select("site", "url", "depth", "ordinal", "status")


def _judgements(spark, sf):
    """Every third page's open checks are judged: as PASS, as still open, or with an error, by the number of the check."""
    v = audit(spark, sf).verdicts.withColumn("evidence", F.lit("seen"))
    n = F.substring("check_id", 2, 3).cast("int")
    j = v.where("value = 'NEEDS_REVIEW' and page_id % 3 = 0").select("hash", "check_id", F.when(n % 3 == 0, "PASS").when(n % 3 == 1, "NEEDS_REVIEW").alias("value"), F.lit("judged").alias("evidence"), F.lit("0.9").alias("confidence"), F.when(n % 3 == 2, "no answer").alias("error"))
    return judge.apply_judgements(v, j.dropDuplicates(["hash", "check_id"]))


def _streamed_site_checks(spark, sf):
    """The three site-wide checks, from a stream that gets the pages in mixed order, in several batches."""
    folder = Folder(spark, "site-checks")
    pages = page_table(spark, sf).select("page_id", "site", "url", "html")
    folder.written(pages.repartition(6, F.sha1("url")), "pages")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder.path}/pages")
    site_checks.site_checks_stream(stream, f"{folder.path}/said", f"{folder.path}/checkpoint").awaitTermination()
    known = site_checks.settled(spark.read.schema(site_checks.CORRECTION).parquet(f"{folder.path}/said/*"))
    return pages.select("page_id", "url").join(known, "url").select("page_id", "check_id", "value")


def _first_seen_log(spark, sf):
    """The page table as three runs of a crawl that goes deeper each time, the last one with all pages."""
    log = seenlog.SeenLog(spark, Folder(spark, "seen").path, buckets=64, most=2)
    pages = page_table(spark, sf).select("site", "url", ux.url_depth(c("url")).alias("depth"))
    for k in (1, 2, 3):
        log.append(pages.where(f"depth <= {k} or {k} = 3").withColumn("status", F.lit(200 + k)), f"run{k}")
    return log.tree()


def _latest_run(spark, sf):
    """Each page as a run of its site, at as many minutes as its id says; half of the markers come twice, all in mixed order."""
    folder = Folder(spark, "runs")
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + c("page_id") * 60), "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")
    commits = page_table(spark, sf).select("site", at.alias("run_id"), F.lit(1).cast("long").alias("rows"))
    commits = commits.unionByName(commits.where("substring(run_id, 16, 1) in ('1', '3', '5', '7', '9')"))
    commits.repartition(7, F.sha1(F.concat("run_id", "site"))).write.json(f"{folder.path}/commits/pages")
    runs.latest_stream(spark, folder.path, "pages", f"{folder.path}/latest", f"{folder.path}/checkpoint", late="100000 days", at_once=2).awaitTermination()
    return runs.latest_runs(spark, f"{folder.path}/latest")


def _duplicate_examples(spark, sf):
    pages = audit(spark, sf).snapshots
    marked = pages.select("page_id", "site", "url", context.signature().alias("signature"))
    return marked.join(examples.duplicate_examples(pages), ["site", "url", "signature"]).select("page_id", "others", F.array_join("examples", " ").alias("examples"))


def _second_opinion(spark, sf):
    """All verdicts after a judgement of every open one: as PASS, as FAIL, as still open, or with an error, by check."""
    v = audit(spark, sf).verdicts.withColumn("evidence", F.lit("seen"))
    n = F.substring("check_id", 2, 3).cast("int") % 4
    j = v.where("value = 'NEEDS_REVIEW'").select("hash", "check_id", F.when(n == 0, "PASS").when(n == 1, "FAIL").when(n == 2, "NEEDS_REVIEW").alias("value"), F.lit("read").alias("evidence"), F.lit("0.8").alias("confidence"), F.when(n == 3, "no answer").alias("error"))
    return judge.apply_judgements(v, j.dropDuplicates(["hash", "check_id"]))


def _rescored(spark, sf):
    """The views of the audit, and then what the judgements changed folded into them."""
    before = deltas.Views.of(audit(spark, sf).verdicts).written(Folder(spark, "views").written)
    return before.apply(deltas.judgement_deltas(_second_opinion(spark, sf)))


def _rescored_matrix(spark, sf):
    return _rescored(spark, sf).check_matrix().select("site", "check_id", *(c(x).cast("long") for x in ("pass", "fail", "na", "needs_review")))


def _rescored_priority(spark, sf):
    return _rescored(spark, sf).ranked.select("site", "check_id", "fail_pct", "priority", "bucket", c("rank").cast("long"))


def _bucket_counts(spark, sf):
    return scoring.bucket_counts(audit(spark, sf).scores, ["site"]).select("site", "bucket", c("pages").cast("long"))


def _top_issues(spark, sf):
    return scoring.top_issues(_whole_matrix(spark, sf)).select("check_id", c("fail").cast("long"), c("needs_review").cast("long"))


def _report_areas(spark, sf):
    return compare.report_areas(_whole_matrix(spark, sf)).select("check_id", "severity", "gap_category", "fail_rate", c("fail").cast("long"))


def _coverage(spark, sf):
    a = audit(spark, sf)
    return scoring.coverage(a.scores, a.verdicts, page_table(spark, sf), ["site"])


def _review_queue(spark, sf):
    return scoring.review_queue(audit(spark, sf).verdicts).select("page_id", "hash", "check_id", "severity", "severity_rank")


def _site_summary(spark, sf):
    return scoring.site_summary(audit(spark, sf).scores).select("site", c("pages").cast("long"), "average_score", *(c(b).cast("long") for b, _ in scoring.BUCKETS))


def _priority_rows(spark, sf):
    return _priority(spark, sf).select("site", "check_id", "fail_pct", "priority", "bucket", c("rank").cast("long"))


def _snapshot(spark, sf):
    s = audit(spark, sf).snapshots
    return s.select("page_id", "title", "lang", "meta_robots", "canonical", F.size("h1").cast("long").alias("h1s"), F.size("links").cast("long").alias("links"), F.size("images").cast("long").alias("images"), c("list_count").cast("long"), c("table_count").cast("long"), "body_length", "html_length", c("sentence_count").cast("long"), "average_sentence_words", "interstitial")


def queries() -> dict:
    body = lambda: tx.body_only(c("html"))
    out = {
        "priority": _priority_rows,
        "checklist": lambda spark, sf: checks_table(spark).select("check_id", "severity", "gap_category", "scope", "weight", "factor", "excluded"),
        "body_only": _page(lambda: [body().alias("body")]),
        "strip_tags": _page(lambda: [tx.strip_tags(c("html")).alias("text")]),
        "visible_text": _page(lambda: [tx.visible_text(body()).alias("text")]),
        "page_title": _page(lambda: [extract.page_title(c("html")).alias("title")]),
        "page_lang": _page(lambda: [extract.page_lang(c("html")).alias("lang")]),
        "headings": _headings,
        "links": _links,
        "links_in_chrome": _links_in_chrome,
        "list_count": _page(lambda: [extract.list_count(body()).cast("long").alias("n")]),
        "table_count": _page(lambda: [extract.table_count(body()).cast("long").alias("n")]),
        "sentence_stats": lambda spark, sf: page_table(spark, sf).select("page_id", tx.visible_text(body()).alias("t")).select("page_id", *_sentences(c("t"))),
        "sentence_stats_documents": _sentence_stats_documents,
        "interstitial": _page(lambda: [extract.interstitial(body()).alias("candidate")]),
        "decode_entities": _page(lambda: [tx.decode_entities(c("html")).alias("text")]),
        "url_hash": _page(lambda: [ux.url_hash(c("url")).alias("hash")]),
        "url_depth": _page(lambda: [ux.url_depth(c("url")).cast("long").alias("depth")]),
        "url_filename": _page(lambda: [ux.filename_of(c("url")).alias("filename")]),
        "normalize_url": _page(lambda: [ux.normalize_url(c("url")).alias("normal")]),
        "site_of_page": _page(lambda: [c("site")]),
        "page_type": _page(lambda: [rules.path_type(c("url")).alias("type")]),
        "www_alias": _www_alias,
        "host_filter": _host_filter,
        "select_urls": _select_urls,
        "inbound_links": _inbound,
        "link_targets": _targets,
        "sitemap_membership": _sitemap,
        "duplicate_intent": lambda spark, sf: context.with_duplicates(audit(spark, sf).snapshots).select("page_id", "competing"),
        "site_multilingual": lambda spark, sf: context.site_languages(audit(spark, sf).snapshots).select("site", c("languages").cast("long"), "multilingual"),
        "dedupe_canonical": _dedupe_canonical,
        "page_snapshot": _snapshot,
        **{f"check_{n:03d}": _check(n) for n, *_ in CHECKS},
        "polite_fetch": _polite_fetch,
        "rescored_matrix": _rescored_matrix,
        "rescored_scores": lambda spark, sf: _rescored(spark, sf).scores().select("page_id", "score", "bucket"),
        "rescored_priority": _rescored_priority,
        "verdict_deltas": lambda spark, sf: deltas.judgement_deltas(_second_opinion(spark, sf)).select("page_id", "check_id", "value", "sign"),
        "first_seen_log": _first_seen_log,
        "latest_run": _latest_run,
        "duplicate_examples": _duplicate_examples,
        "page_ordinals": lambda spark, sf: sampling.with_ordinals(page_table(spark, sf).select("page_id", "url"), ["url", "page_id"]).select("page_id", "ordinal"),
        "seeded_sample": lambda spark, sf: sampling.seeded_sample(page_table(spark, sf)).select("place", "page_id", "url"),
        "streamed_crawl": _streamed_crawl,
        "streamed_site_checks": _streamed_site_checks,
        "verdicts": lambda spark, sf: audit(spark, sf).verdicts.select("page_id", "check_id", "value"),
        "review_queue": _review_queue,
        "check_matrix": _matrix,
        "page_scores": lambda spark, sf: audit(spark, sf).scores.select("page_id", "score", "bucket"),
        "bucket_counts": _bucket_counts,
        "site_summary": _site_summary,
        "top_issues": _top_issues,
        "coverage": _coverage,
        "priority_bucket_counts": lambda spark, sf: priority.priority_bucket_counts(_priority(spark, sf), ["site"]).select("site", "bucket", c("checks").cast("long")),
        "priority_dividers": lambda spark, sf: priority.dividers(_priority(spark, sf), ["site"]).select("site", "check_id", c("rank").cast("long"), "starts_bucket"),
        "priority_cells": lambda spark, sf: priority.cells(_priority(spark, sf)).select("site", "check_id", "why", "pct_class"),
        "report_top_areas": _report_areas,
        "compare_checks": _compared,
        "compare_worse": lambda spark, sf: compare.worse(_compared(spark, sf)),
        "compare_better": lambda spark, sf: compare.better(_compared(spark, sf)),
        "compare_warnings": lambda spark, sf: compare.warnings(_compared(spark, sf)),
        "url_tree_merge": _url_tree,
        "apply_judgements": lambda spark, sf: _judgements(spark, sf).select("page_id", "check_id", "value", "judged_by", "confidence", "outcome", "evidence"),
        "judge_tallies": lambda spark, sf: judge.tallies(_judgements(spark, sf)),
        "sample_pages": lambda spark, sf: urlsets.sample_pages(page_table(spark, sf)).select("page_id", "url"),
    }
    return out


def oracle_sql() -> dict[str, str]:
    return oracle_queries()
