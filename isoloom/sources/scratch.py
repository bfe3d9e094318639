"""Tables written to cut lineage, in the folder that the cluster shares.

Each application has a folder of its own there, removed when its driver ends."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _local()).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API, which knows every store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    app = f"{shared_dir(spark)}/isoloom-{spark.sparkContext.applicationId}"
    if app not in _roots:
        _roots[app] = f"{app}-{uuid.uuid4().hex[:8]}"
        fs, at = _hadoop(spark, _roots[app])
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return _roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, at = _hadoop(spark, path)
    return fs.getContentSummary(at).getLength()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of a loop: each round's rows are written before those of the round before are removed."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._name, self._last = spark, name, None

    def written(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self._spark, self._name)
        df.write.parquet(path)
        if self._last:
            fs, at = _hadoop(self._spark, self._last)
            fs.delete(at, True)
        self._last = path
        return self._spark.read.schema(df.schema).parquet(path)
