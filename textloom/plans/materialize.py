"""Intermediate results that survive the loss of executors.

``materialize`` writes a DataFrame as a Parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir`` and returns a DataFrame over that table.  The lineage ends there, the data is
columnar and compressed, and a lost executor costs only the tasks that ran on it.  Where the setting is
absent a folder below the system's temporary folder is used and announced to the session, so
``DataFrame.checkpoint`` works too, but only if all runs on one machine; on a cluster that is an error, as
executors would write to their own disks.  ``release`` removes the tables of a session.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``, or a local one if it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder for the master {master}")
    path = os.path.join(tempfile.gettempdir(), "textloom-shared")
    os.makedirs(path, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("file://" + path)
    return "file://" + path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return it as a table read back; every later use reads the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the tables that this process has written; results that read them are void from then on.  Returns their number."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
