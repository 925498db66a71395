"""A search index of several channels as tables in one folder; channels may be absent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(folder: str, channels: dict[str, DataFrame], meta: dict[str, str]) -> None:
    """Writes every channel, then the table that names them: without it the folder holds no index."""
    spark = next(iter(channels.values())).sparkSession
    for name, rows in channels.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    told = [(json.dumps(sorted(channels)), json.dumps(meta, sort_keys=True))]
    spark.createDataFrame(told, "channels string, meta string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_index")


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(channels, meta) as saved."""
    row = spark.read.parquet(f"{folder}/_index").first()
    return {name: spark.read.parquet(f"{folder}/{name}") for name in json.loads(row["channels"])}, json.loads(row["meta"])


def with_channel(rows: DataFrame, channels: dict[str, DataFrame], name: str, key: str, default: float = 0.0) -> DataFrame:
    """``rows`` with the score that the channel gives to each key; ``default`` where it gives none, for all rows if the channel is absent."""
    if name not in channels:
        return rows.withColumn(name, F.lit(default))
    return rows.join(channels[name].select(key, F.col("score").alias(name)), key, "left").fillna(default, [name])
