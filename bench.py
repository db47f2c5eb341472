"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. Each query is written in full.

Times are means of two runs after a warm one (of one for the whole audit); the audit's tables are built anew in `audit_full`, and the
aggregates behind it read them, as they do in use.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pagewright.plans import audit as audits
    from pagewright.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def audit_full():
        a = audits.Audit(audits.page_table(spark, SF))
        n = a.verdicts.count()
        a.clean()
        return n

    def run(name):
        registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()

    names = ["visible_text", "headings", "links", "sentence_stats", "sentence_stats_documents", "check_matrix", "page_scores", "priority", "compare_checks", "report_top_areas", "review_queue", "apply_judgements"]
    out = {}
    for name, f in [("audit_full", audit_full), *((n, lambda n=n: run(n)) for n in names)]:
        f()
        took = []
        for _ in range(1 if name == "audit_full" else 2):
            t = time.time()
            f()
            took.append(time.time() - t)
        out[name] = round(statistics.mean(took), 3)
    rows = spark.read.parquet(f"{SF}/pages.parquet").count()
    print(json.dumps({"metric": "audit_total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF.rstrip("/").rsplit("sf", 1)[-1], "pages_per_second": round(rows / out["audit_full"], 1)}))


if __name__ == "__main__":
    main()
