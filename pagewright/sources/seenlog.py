"""First-seen URLs as a log of deltas: a run writes the URLs that are new, and nothing else again.

URLs lie in buckets by hash. Beside its rows, a delta holds a Bloom filter for each of its buckets: a bitmap of 32,768
bits with `PROBES` bits for each URL, built by Spark's bitmap aggregates. A run's URLs meet the filters of their buckets
first; most are new, and a missing bit says so. Only what all bits claim to know is compared with the rows of
those buckets. After `most` deltas they are merged into one, under a new name, and a manifest names the folders
that count; so readers never see half a log, and a run that is written again replaces itself.

Defined results: the first run that has a URL gives its first_seen and first_status; entries are never refreshed; a URL
twice in a run has its least status; a null site or url is a value like any other; an empty run makes no delta.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "site string, url string, first_seen string, first_status int"
BITS = 32_768
PROBES = 4


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("site", "url"), F.lit(buckets)).cast("int")


def probe(k: int) -> Column:
    """The k-th bit of a URL in its bucket's filter."""
    return F.pmod(F.xxhash64(F.lit(k), "site", "url"), F.lit(BITS)).cast("int")


def bloom(rows: DataFrame) -> DataFrame:
    """bucket and bits, the filter of rows(bucket, site, url)."""
    return rows.select("bucket", F.explode(F.array(*map(probe, range(1, PROBES + 1)))).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def has_bit(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


class SeenLog:
    """A log below `path`. buckets is fixed when the log begins: about one for each 2,500 URLs keeps a filter at under 1 % of false claims."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, most: int = 16):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        self.manifest = self._manifest() or {"buckets": buckets, "folders": []}
        self.buckets = self.manifest["buckets"]

    # -- files --------------------------------------------------------------------------------------------

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        """The greatest of the numbered manifests; each is written once."""
        p, fs = self._file("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]) | {"version": int(names[-1][:-5])} if names else None

    def _commit(self, folders: list[str]) -> None:
        version = self.manifest.get("version", 0) + 1
        p, fs = self._file(f"manifests/{version:09d}.json")
        out = fs.create(p, False)  # two writers cannot both make it
        try:
            out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        finally:
            out.close()
        self.manifest = {"buckets": self.buckets, "folders": folders, "version": version}

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self.manifest["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/").parquet(*(f"{self.path}/{f}/{kind}" for f in self.manifest["folders"]))

    # -- the log ------------------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """bucket, site, url, first_seen and first_status of everything seen."""
        return reduce(DataFrame.unionByName, (self.spark.read.schema(f"{TREE}, bucket int").parquet(f"{self.path}/{f}/rows") for f in self.manifest["folders"]), self.spark.createDataFrame([], f"{TREE}, bucket int"))

    def filters(self) -> DataFrame:
        """bucket and bits of the whole log."""
        return self._read("filters", "bucket int, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def tree(self) -> DataFrame:
        return self.rows().drop("bucket")

    def unseen(self, run: DataFrame) -> DataFrame:
        """bucket, site, url, first_seen and first_status of what the log lacks of run(site, url, run_id, status)."""
        new = run.groupBy("site", "url").agg(F.min(F.struct("run_id", "status")).alias("x")).select("site", "url", F.col("x.run_id").alias("first_seen"), F.col("x.status").cast("int").alias("first_status"))
        new = new.withColumn("bucket", bucket_of(self.buckets))
        if not self.manifest["folders"]:
            return new
        claimed = F.col("bits").isNotNull()
        for k in range(1, PROBES + 1):
            claimed &= has_bit(F.col("bits"), probe(k))
        met = new.join(self.filters(), "bucket", "left").withColumn("claimed", F.coalesce(claimed, F.lit(False))).drop("bits")
        # rows lie in folders by bucket; one number for each bucket prunes those without a claim
        asked = F.broadcast(met.where("claimed").select("bucket").distinct())
        known = self.rows().join(asked, "bucket", "left_semi").select(F.col("bucket").alias("b"), F.col("site").alias("s"), F.col("url").alias("u"))
        same = F.col("claimed") & (F.col("bucket") == F.col("b")) & F.col("site").eqNullSafe(F.col("s")) & F.col("url").eqNullSafe(F.col("u"))
        return met.join(known, same, "left_anti").drop("claimed")

    def append(self, run: DataFrame, run_id: str) -> int:
        """Adds the URLs of run(site, url, status) that the log lacks, as delta `run_id`; returns how many they are."""
        name = f"delta-{run_id}"
        if name in self.manifest["folders"]:
            raise ValueError(f"run {run_id} is in the log")
        new = self.unseen(run.select("site", "url", F.lit(run_id).alias("run_id"), "status"))
        new.repartition(F.col("bucket")).sortWithinPartitions("bucket", "site", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/rows")
        written = self.spark.read.schema(f"{TREE}, bucket int").parquet(f"{self.path}/{name}/rows")
        n = written.count()
        if n:
            bloom(written).write.mode("overwrite").parquet(f"{self.path}/{name}/filters")
            self._commit([*self.manifest["folders"], name])
            if len(self.manifest["folders"]) > self.most:
                self.compact()
        return n

    def compact(self) -> None:
        """Merges all deltas into one folder. The old ones stay for readers that have begun, until clean()."""
        name = f"base-{self.manifest['version']:09d}"
        self.rows().repartition(F.col("bucket")).sortWithinPartitions("bucket", "site", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/rows")
        self.filters().write.mode("overwrite").parquet(f"{self.path}/{name}/filters")
        self._commit([name])

    def clean(self) -> None:
        """Deletes the folders that no longer count."""
        p, fs = self._file("")
        for s in fs.listStatus(p):
            n = s.getPath().getName()
            if n.startswith(("delta-", "base-")) and n not in self.manifest["folders"]:
                fs.delete(s.getPath(), True)
