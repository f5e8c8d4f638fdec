"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of local runs that name none, by application: nothing is set in the caller's session.
_local_roots: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a temporary folder of this application (local runs) or one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate"
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below work_root; what is written there goes when the driver's JVM ends."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: what several branches read is computed once, and a lost executor loses nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
