"""The event log as a stream. Every function takes a batch or a streaming frame and means the same on both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def derived(events: DataFrame) -> DataFrame:
    """What the log stores: truncated kind, day, whether something was found (null when unknown)."""
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), F.left("event_type", F.lit(40)).alias("kind"), "value", (F.col("value") > 10).alias("found"))


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Repeated deliveries of an event go; a stream forgets ids when the watermark has passed them."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days: counts and totals by kind."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("window.start").alias("day"), "kind", "n", "total")


def rate(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding windows: events by kind in each."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width, step), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Gap-based sessions of a user."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("began"), "n")


def last_values(events: DataFrame, n: int = 1024) -> DataFrame:
    """(kind, count, p50, p95) over each kind's last ``n`` values by arrival, kept as state; a streaming operator."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for batch in batches:
            kept += batch.sort_values("event_id")["value"].tolist()
            kept = kept[-n:]
        state.update((kept,))
        ordered = sorted(kept)
        at = lambda q: ordered[max(0, min(len(ordered) - 1, round(q * len(ordered)) - 1))]
        yield pd.DataFrame({"kind": [key[0]], "n": [len(ordered)], "p50": [at(0.5)], "p95": [at(0.95)]})

    grouped = events.select("kind", "event_id", "value").groupBy("kind")
    return grouped.applyInPandasWithState(update, "kind string, n bigint, p50 double, p95 double", "vals array<double>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, then stops; parquet sink, exactly once by its checkpoint."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
