"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import shared_dir

_written: list[str] = []


def saved(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The copy survives lost executors and ends the lineage. It stays, as results
    that were built on it may still be read, until ``clear`` or until the folder
    is cleared like that of any checkpoint.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes the tables that this driver has saved, when no result built on them is needed any more; returns their number."""
    jvm = spark.sparkContext._jvm
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
