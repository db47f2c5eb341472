"""Tables written once to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _temporary:
        _temporary.append("file://" + tempfile.mkdtemp(prefix="pagewright-audit-"))
    return _temporary[0]


class Folder:
    """A folder of written tables, deleted when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clean)

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def clean(self) -> None:
        with contextlib.suppress(Exception):
            p, fs = self._file(self.path)
            fs.delete(p, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
