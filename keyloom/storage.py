"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process (tests) below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    path = f"{base.rstrip('/')}/keyloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: what several branches of a plan need is computed once,
    and survives the loss of an executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, name: str) -> DataFrame:
    """``cut`` with a folder for each value of a column that has few: what asks for one value reads no other."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(name).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
