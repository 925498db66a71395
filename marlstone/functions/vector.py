"""Vector expressions that stay in the JVM; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def blend(a: Column, b: Column, share: float) -> Column:
    return unit(F.zip_with(a, b, lambda x, y: x.cast("double") * (1 - share) + y.cast("double") * share))


def centroids(df: DataFrame, vector: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """One mean vector a group, from sums by position: partial sums combine before the exchange."""
    weight = F.lit(1.0) if weight is None else weight
    spread = df.select(*by, weight.alias("__w"), F.posexplode(vector).alias("__at", "__x"))
    means = spread.groupBy(*by, "__at").agg((F.sum(F.col("__x").cast("double") * F.col("__w")) / F.sum("__w")).alias("__mean"))
    gathered = F.sort_array(F.collect_list(F.struct("__at", "__mean")))
    return means.groupBy(*by).agg(F.transform(gathered, lambda s: s["__mean"]).alias("centroid"))
