"""Connected components and joins that stay even when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import saved

#: A key is hot above the larger of these: so many rows, or this share of all rows. At most 1 / share keys are hot.
HOT_ROWS = 1_000
HOT_SHARE = 0.001


def lookup(rows: DataFrame, side: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key and in ``copies`` the key's number of rows.

    Keys that hold over ``HOT_SHARE`` of the ``total`` rows are fewer than its
    inverse, so they are broadcast and their rows stay where they are; the rest
    is joined by shuffle.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    if total <= limit:
        return rows.join(side, key)
    hot = F.broadcast(side.filter(F.col(copies) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(side.filter(F.col(copies) <= limit), key)
    return cold.unionByName(rows.join(hot, key))


def _star(edges: DataFrame, total: int) -> DataFrame:
    """(node, other) to (other, smallest of node and its others)."""
    least = edges.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("copies"))
    least = least.withColumn("least", F.least("node", "least"))
    return lookup(edges, least, "node", "copies", total)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), the smallest node that each linked node reaches.

    Large-star and small-star rounds by turns: each links every node's others to
    the smallest of them, until all hang on their component's smallest node. The
    links are written to the shared folder after every round, so each round is
    one job from files; their number and a sum of hashes tell when they rest.
    """
    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = saved(df.distinct(), "links")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())

    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now, mark = settled(edges.filter("a <> b").select(larger.alias("node"), smaller.alias("other")))
    while mark[0]:
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(both, 2 * mark[0]).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = large.filter("node <> other")
        middle = saved(large.distinct(), "links")
        small = _star(middle, mark[0])
        pairs = F.array(F.struct(F.col("other").alias("node"), F.col("least").alias("other")), F.struct(F.col("node"), F.col("least").alias("other")))
        small = small.select(F.explode(pairs).alias("p")).select("p.node", "p.other").filter("node <> other")
        now, after = settled(small)
        if after == mark:
            break
        mark = after
    return now.select("node", F.col("other").alias("component"))
