"""The artifact store: Parquet folders for each site and run, and small JSON records.

<root>/<kind>/site=<site>/run_id=<stamp>/ holds crawls, verdicts and scores. Runs are immutable; the latest one is the
greatest stamp. Everything goes through Spark or its file system, so the root may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.urlsets import add_competitors
from pagewright.sources.seenlog import SeenLog

COMPETITORS = "target string, competitor string, ordinal int"


def stamp(now: datetime | None = None) -> str:
    """A UTC time with milliseconds that sorts as text and suits file names."""
    t = (now or datetime.now(UTC)).astimezone(UTC)
    return t.strftime("%Y-%m-%dT%H-%M-%S-") + f"{t.microsecond // 1000:03d}Z"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files --------------------------------------------------------------------------------------------

    def _path(self, rel: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, rel: str) -> list[str]:
        p, fs = self._path(rel)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, rel: str) -> bool:
        p, fs = self._path(rel)
        return fs.exists(p)

    def write_text(self, rel: str, text: str) -> str:
        p, fs = self._path(rel)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return f"{self.root}/{rel}"

    def read_text(self, rel: str) -> str | None:
        if not self.exists(rel):
            return None
        return self.spark.read.text(f"{self.root}/{rel}", wholetext=True).first()[0]

    def write_json(self, rel: str, value) -> str:
        return self.write_text(rel, json.dumps(value, indent=2, ensure_ascii=False) + "\n")

    def read_json(self, rel: str):
        text = self.read_text(rel)
        return None if text is None else json.loads(text)

    # -- runs ---------------------------------------------------------------------------------------------

    def write_run(self, kind: str, site: str, run_id: str, df: DataFrame) -> DataFrame:
        """Raises if the run is there already. Its commit marker follows when all of it is written."""
        path = f"{self.root}/{kind}/site={site}/run_id={run_id}"
        df.drop("site", "run_id").write.mode("errorifexists").parquet(path)
        self.commit(kind, site, run_id)
        return self.read_run(kind, site, run_id)

    def commit(self, kind: str, site: str, run_id: str) -> None:
        """The marker that streams of runs wait for: one row of JSON."""
        rows = self.spark.read.parquet(f"{self.root}/{kind}/site={site}/run_id={run_id}").count()
        self.write_text(f"commits/{kind}/{site}-{run_id}.json", json.dumps({"site": site, "run_id": run_id, "rows": rows}) + "\n")

    def run_ids(self, kind: str, site: str) -> list[str]:
        return [n.removeprefix("run_id=") for n in self.names(f"{kind}/site={site}") if n.startswith("run_id=")]

    def sites(self, kind: str) -> list[str]:
        return [n.removeprefix("site=") for n in self.names(kind) if n.startswith("site=")]

    def latest(self, kind: str, site: str) -> str | None:
        return max(self.run_ids(kind, site), default=None)

    def read_run(self, kind: str, site: str, run_id: str | None = None) -> DataFrame | None:
        """A run, or the latest one; None if there is none."""
        run_id = run_id or self.latest(kind, site)
        if not run_id or not self.exists(f"{kind}/site={site}/run_id={run_id}"):
            return None
        return self.spark.read.parquet(f"{self.root}/{kind}/site={site}/run_id={run_id}").withColumns({"site": F.lit(site), "run_id": F.lit(run_id)})

    def status(self, site: str | None = None) -> list[dict]:
        names = sorted(set(self.sites("pages")) | set(self.sites("verdicts")))
        return [{"site": s, "crawls": len(self.run_ids("pages", s)), "last_crawl": self.latest("pages", s), "analyses": len(self.run_ids("verdicts", s)), "last_analysis": self.latest("verdicts", s)} for s in names if site in (None, s)]

    # -- records ------------------------------------------------------------------------------------------

    def update_site(self, site: str, **facts) -> dict:
        """Merges facts into the site's record."""
        record = {**(self.read_json(f"sites/{site}.json") or {}), **facts, "site": site}
        self.write_json(f"sites/{site}.json", record)
        return record

    def _seen(self, site: str) -> SeenLog:
        return SeenLog(self.spark, f"{self.root}/url-log/{site}", buckets=16)

    def url_tree(self, site: str) -> DataFrame:
        return self._seen(site).tree()

    def extend_url_tree(self, site: str, run: DataFrame, run_id: str) -> DataFrame:
        """Adds the URLs of run(site, url, status) that the tree lacks; only these are written."""
        log = self._seen(site)
        log.append(run, run_id)
        return log.tree()

    def competitors(self, target: str) -> list[str]:
        return (self.read_json(f"competitors/{target}.json") or {}).get("competitors", [])

    def add_competitors(self, target: str, domains: list[str]) -> list[str]:
        known = self.spark.createDataFrame([(target, c, k) for k, c in enumerate(self.competitors(target))], COMPETITORS)
        out = [r["competitor"] for r in add_competitors(known, target, domains).orderBy("ordinal").collect()]
        self.write_json(f"competitors/{target}.json", {"target": target, "competitors": out})
        return out
