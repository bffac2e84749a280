"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return _own[app]


def place(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{root(spark)}/tickloom-{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str = "t", tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and return a reader of what was written.

    tasks: write with no more than so many, where the caller knows how little there is.

    (With zstd, whose buffers lie on the heap; those of the default codec pile up outside it over many small files.)
    """
    path = place(df.sparkSession, name)
    if tasks:
        df = df.coalesce(tasks)
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tickloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what settle() wrote; only for tables that nothing will read again."""
    path = df.__dict__.get("_tickloom_path")
    if path:
        remove(df.sparkSession, path)


def let_go(spark: SparkSession) -> None:
    """Collect what is no longer used: the files of past shuffles stay on the executors until the driver does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
