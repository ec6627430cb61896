"""Cutting lineage in storage that survives lost executors.

Intermediate tables live under the folder that the session names in
``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder,
as in tests; on a cluster it is an error, since executors would not see a folder of
the driver.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        found = tempfile.mkdtemp(prefix="lumenshelf-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` computed once, written to the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a table's folder or file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = store.getContentSummary(p)
    return summary.getLength(), summary.getFileCount(), store.getFileStatus(p).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
