"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, one of this machine's folders will do if Spark runs on this machine alone; on a cluster
    executors would write to their own disks, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="docquarry-")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder on whatever file system it is; whether it was there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _listed(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the files in a folder, by name."""
    return {s.getPath().getName(): s.getLen() for s in _listed(spark, path) if s.isFile()}


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    return sorted(s.getPath().getName() for s in _listed(spark, path) if s.isDirectory())


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for what is read several times."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
