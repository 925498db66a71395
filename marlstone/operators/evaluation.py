"""Evaluation of rankings: label sets, metrics, result files, and the gate that a build must pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.relational import numbered, ranked
from marlstone.session import kept

#: Errors that a failed label set names; all are counted.
NAMED = 20


def label_set(hints: DataFrame, items: DataFrame, dev_share: float = 2 / 3, seed: int = 7) -> DataFrame:
    """(qid, query, item_id, title, split): every hint resolved to one item, with a seeded split; raises ValueError otherwise.

    ``hints`` has qid, query, hint, year; ``items`` has item_id, title, year. A
    hint means the item of its year whose title holds it, the shortest title
    first, then the smallest id. A hint without an item and two hints with the
    same item are errors.
    """
    held = hints.join(items.withColumnRenamed("item_id", "found_id"), "year", "left").filter(F.col("title").isNull() | F.contains(F.lower("title"), F.lower("hint")))
    best = ranked(held, [F.length("title"), F.col("found_id")], ["qid"], "__rank").filter("__rank = 1")
    found = hints.select("qid", "query").join(best.select("qid", F.col("found_id").alias("item_id"), "title"), "qid", "left")
    many = F.count("*").over(Window.partitionBy("item_id"))
    bad = found.withColumn("n", many).withColumn("error", F.when(F.col("item_id").isNull(), "no item").when(F.col("n") > 1, "item of several")).filter("error IS NOT NULL")
    errors = bad.agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.concat_ws(": ", "qid", "error"))), 1, NAMED).alias("some")).first()
    if errors["n"]:
        raise ValueError(f"{errors['n']} labels do not resolve: {', '.join(errors['some'])}")
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col("qid").cast("string"))), F.col("qid").cast("string"))
    placed = numbered(found.withColumn("__order", order), "__order", F.substring("__order", 1, 2), "__k").crossJoin(F.broadcast(found.agg(F.count("*").alias("__n"))))
    split = F.when(F.col("__k") < F.bround(F.col("__n") * dev_share), "dev").otherwise("test")
    return placed.select("qid", "query", "item_id", "title", split.alias("split"))


def target_ranks(queries: DataFrame, relevant: DataFrame, rank_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, rank): the best place of a relevant key in the full order that ``rank_fn`` gives, null if it has none.

    ``rank_fn`` takes (qid, query) and returns (qid, key, score); ties go to the
    smaller key. ``relevant`` has qid and key.
    """
    return queries.select("qid").join(best_ranks(rank_fn(queries), relevant), "qid", "left")


def best_ranks(scored: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, rank): the place of each query's first relevant key in (qid, key, score), by score, then the smaller key.

    The place is one more than the number of keys before it, so nothing is sorted; only the first relevant keys, one a query, are handed round.
    """
    scored = kept(scored, "scored")  # two readers
    place = F.struct((-F.col("score")).alias("down"), "key")
    first = scored.join(relevant, ["qid", "key"]).groupBy("qid").agg(F.min(place).alias("__first"))
    met = scored.join(F.broadcast(first), "qid")
    return met.groupBy("qid").agg((F.count_if(place < F.col("__first")) + 1).alias("rank"))


def rank_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mrr, ndcg10, recall10, recall50, precision10, hits1, hits3, median_rank and mean_rank of (rank), one relevant key a query; a missing rank is a miss."""
    rank = F.col("rank")
    share = lambda k, value: F.round(F.avg(F.when(rank <= k, value).otherwise(0.0)), 6)
    return ranks.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 6).alias("mrr"),
        share(10, 1 / F.log2(rank + 1)).alias("ndcg10"), share(10, F.lit(1.0)).alias("recall10"), share(50, F.lit(1.0)).alias("recall50"), share(10, F.lit(0.1)).alias("precision10"),
        share(1, F.lit(1.0)).alias("hits1"), share(3, F.lit(1.0)).alias("hits3"),
        F.median("rank").alias("median_rank"), F.round(F.avg("rank"), 6).alias("mean_rank"),
    )


def write_results(metrics: DataFrame, folder: str, split: str, stamp: str) -> None:
    """A snapshot of the run, the same as the split's latest, and its rows appended to the history, as JSON lines."""
    rows = metrics.withColumn("split", F.lit(split)).withColumn("timestamp", F.lit(stamp)).coalesce(1)
    rows.write.mode("errorifexists").json(f"{folder}/{stamp.replace(':', '-')}__{split}")
    rows.write.mode("overwrite").json(f"{folder}/latest__{split}")
    rows.write.mode("append").json(f"{folder}/history")


class BelowGate(AssertionError):
    pass


def gate(metrics: DataFrame, metric: str, bound: float) -> float:
    """The metric of a one-row table; raises ``BelowGate`` if it is under the bound or was not measured."""
    row = metrics.select(metric).first()
    if row is None or row[0] is None or row[0] < bound:
        raise BelowGate(f"{metric}: {row and row[0]} is below {bound}")
    return row[0]
