"""Readers and writers with fixed schemas. Nothing is inferred, and bad cells become null rather than errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(spark: SparkSession, path: str, schema: str, null: str = r"\N") -> DataFrame:
    """Tab-separated with a header and a null marker, compressed or not; read as text, then cast tolerantly."""
    fields = [c.strip().split(" ", 1) for c in schema.split(",")]
    raw = spark.read.csv(path, sep="\t", header=True, nullValue=null, quote="", schema=", ".join(f"{name} string" for name, _ in fields))
    return raw.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in fields])


def known_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``known``."""
    return df.join(known.select(key), key, "left_semi")


def ratings_csv(spark: SparkSession, path: str, min_ratings: int = 1) -> DataFrame:
    """(user_id, movie_id, rating, rated_at): users with fewer rows than ``min_ratings`` are left out."""
    rows = spark.read.csv(path, header=True, schema="userId bigint, movieId bigint, rating double, timestamp bigint")
    rows = rows.select(F.col("userId").alias("user_id"), F.col("movieId").alias("movie_id"), "rating", F.timestamp_seconds("timestamp").alias("rated_at"))
    if min_ratings <= 1:
        return rows
    enough = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_ratings)
    return rows.join(enough, "user_id", "left_semi")


def links_csv(spark: SparkSession, path: str) -> DataFrame:
    """(movie_id, external_id) without blank or unreadable ids."""
    rows = spark.read.csv(path, header=True, schema="movieId string, imdbId string, tmdbId string")
    ids = rows.select(F.col("movieId").try_cast("bigint").alias("movie_id"), F.trim("tmdbId").try_cast("bigint").alias("external_id"))
    return ids.dropna()


def diary_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, year, rating): rows without a name or a readable rating are dropped, a bad year is null."""
    raw = spark.read.csv(path, header=True, schema="Date string, Name string, Year string, URI string, Rating string, Review string", enforceSchema=True)
    rows = raw.select(F.trim("Name").alias("name"), F.col("Year").try_cast("int").alias("year"), F.col("Rating").try_cast("double").alias("rating"), F.col("Review").alias("review"))
    return rows.filter("name <> '' AND rating IS NOT NULL")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, split: str | None = None, splits: tuple[str, ...] = ()) -> DataFrame:
    """One record a line; with ``split`` only that part, which has to be one of ``splits``."""
    if split is not None and split not in splits:
        raise ValueError(f"split {split!r} is none of {splits}")
    rows = spark.read.schema(schema).json(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of the files under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"))


def append_by_day(events: DataFrame, path: str) -> None:
    """Appends to a table partitioned by day, so retention drops whole partitions."""
    events.write.mode("append").partitionBy("day").parquet(path)


def with_missing_columns(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, as nulls: the late columns of an older table."""
    spark = df.sparkSession
    return df.unionByName(spark.createDataFrame([], schema), allowMissingColumns=True)
