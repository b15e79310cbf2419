"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our
    own on a single machine; on a cluster that raises, as executors could not read each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folioflux-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder, or (at_exit) when the session's JVM ends."""
    files, where = _files(spark, path)
    files.deleteOnExit(where) if at_exit else files.delete(where, True)


def written(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives a lost executor. Deleted when the session ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition) if partition else out).parquet(path)
    remove(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)
