"""Intermediate tables in the folder that the whole cluster shares.

A multi-pass plan is cut by writing a Parquet table and reading it back: the
lineage ends there, a lost executor costs only the tasks it was running, and the
table is read with column pruning. The folder is ``spark.checkpoint.dir`` of the
session. Where that is unset, a folder of this machine takes its place if the master is
local (tests, a laptop), and anything else is refused: executors of a cluster would each
write to their own disk.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one if none is configured and the master is local."""
    found = spark.conf.get(KEY, None)
    if found:
        return found
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"{KEY} must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}/shelfmark-shared"


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shelfmark-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
