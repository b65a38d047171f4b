"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder under /tmp for a local master alone; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file:///tmp/vouch-scratch').rstrip('/')}/vouch-{spark.sparkContext.applicationId}"


def _at(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _at(spark, path)
    return files.exists(there)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    files, there = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(there)] if files.exists(there) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    files, there = _at(spark, path)
    files.delete(there, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut, and any executor can read it."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
