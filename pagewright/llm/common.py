"""What the corpus operators share: reading tables, scratch tables in the shared folder, word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here states it.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's own setting that deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="pagewright-"))
    return _own_folder[0]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[str, SparkSession] = {}


@atexit.register
def release() -> None:
    """Deletes all scratch tables of this process. A long session calls it between jobs, when no frame that an operator
    returned is still to be read."""
    while _roots:
        root, spark = _roots.popitem()
        with contextlib.suppress(Exception):
            delete(spark, root)


class Scratch:
    """Tables written once to the shared folder and read again, which cuts lineage and survives lost executors.

    The shuffle files of a table's query go as soon as it is written. drop() removes a table that nothing reads any
    more; the others go with release(), at the latest when the process ends, since the frames that operators return are
    lazy and may read them at any time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/pagewright/{name}-{uuid.uuid4().hex}", 0
        _roots[self.root] = spark

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t.scratch_path)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """`row`, a struct of all columns of df, and the keys; so no name of df can clash with those that an operator uses."""
    return df.select(F.struct(*(_quoted(c) for c in df.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of what packed() took, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def crc32_text(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(text_or_empty(text).cast("binary"))
