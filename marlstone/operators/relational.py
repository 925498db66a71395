"""Top-k, ranks, dense series, latest-wins and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Numbers rows 1..n in ``order``, within ``by`` if given; the order should end in a key so that reruns agree."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)).cast("bigint"))


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The first k rows, of each group if ``by`` is given. Without groups only k rows reach one task (TakeOrdered)."""
    if by:
        return ranked(df, order, by, name).filter(F.col(name) <= k)
    return ranked(df.orderBy(*order).limit(k), order, None, name)


def numbered(df: DataFrame, key: str, bucket: Column, name: str = "number") -> DataFrame:
    """Numbers rows 0..n-1 by ``key`` without putting all of them into one task.

    ``bucket`` is a coarser form of the key in the same order (its quotient, or a
    prefix): buckets are counted, the few counts are summed in order, and rows
    are numbered within their own bucket.
    """
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return rows.withColumn("__inside", inside).join(offsets, "__bucket").withColumn(name, (F.col("__offset") + F.col("__inside") - 1).cast("bigint")).drop("__bucket", "__inside", "__offset")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return ranked(df, order, keys, "__rank").filter("__rank = 1").drop("__rank")


def dense(df: DataFrame, grid: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Every row of ``grid`` with the measures of ``df``, 0 where it has none."""
    return grid.join(df, keys, "left").fillna(0, zero)


def days(spark, first: str, last: str, name: str = "day") -> DataFrame:
    """One row a day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


def z_scores(df: DataFrame, columns: list[str], clip: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Population z-scores, 0 where the deviation is 0; null stays null. One aggregate pass for all columns, then a one-row join."""
    moments = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if by:
        joined = df.join(df.groupBy(*by).agg(*moments), by)  # as many rows as groups: the planner may broadcast them
    else:
        joined = df.crossJoin(F.broadcast(df.agg(*moments)))  # one row
    for c in columns:
        z = F.when(F.col(f"__s_{c}") > 1e-12, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).when(F.col(c).isNotNull(), 0.0)
        if clip:
            z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
        joined = joined.withColumn(f"z_{c}", F.when(F.col(c).isNotNull(), z))
    return joined.drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def fuse_ranks(lists: list[tuple[DataFrame, float]], key: str, k: int = 20) -> DataFrame:
    """Reciprocal-rank fusion with 0-based ranks: the sum of weight / (k + rank) over the lists that have the key."""
    parts = [df.select(key, (F.lit(weight) / (F.lit(k) + F.col("rank") - 1)).alias("share")) for df, weight in lists]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy(key).agg(F.sum("share").alias("fused"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str, updated: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; the first creation time stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    first = F.min(created).over(Window.partitionBy(*keys))
    return latest(both.withColumn(created, first), keys, [F.col("__new").desc(), F.col(updated).desc()]).drop("__new")


def nearest_rank(values: Column, q: float, formula: str = "round") -> Column:
    """A percentile by index of the sorted array ``values``.

    round: round(q n) - 1, ceil: ceil(q n) - 1, span: round(q (n - 1)), upper: n div 2; indexes from 0, clamped.
    """
    n = F.size(values)
    index = {"round": F.bround(n * q) - 1, "ceil": F.ceil(n * F.lit(q)) - 1, "span": F.bround((n - 1) * q), "upper": F.floor(n / 2)}[formula]
    return F.element_at(values, F.greatest(F.lit(0), F.least(index.cast("int"), n - 1)) + 1)
