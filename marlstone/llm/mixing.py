"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]. Its integral
is the source's cumulative token demand; a document that starts after c words of
its source's stream is needed at the time t where that demand reaches c. The
documents are then sorted by range of that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Slope of each source's schedule, share * (1 + slope * (2 t - 1)), repeating over the sources like the weights.
SLOPES = (0.5, 0.0, -0.5)
SEED = "mix-1"
#: Rows of a bucket of a source's prefix sum that are aimed at; buckets are hex digits of the order key, 16 ** 3 of them at least.
BUCKET_ROWS = 1 << 17
BUCKET_DIGITS = 3


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and equals itself when null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size) to (skey, source_size, weight, slope, target).

    The total of all sizes is shared by weight; no target exceeds ``cap`` times
    its source's size. With the sources ordered by cap / weight, those before
    the first whose share fits are capped and the others share the rest. One row
    per source is all that the windows here see.
    """
    by_key, every = Window.orderBy("skey"), Window.partitionBy()
    rank = (F.row_number().over(by_key) - 1).cast("int")
    pick = lambda options: F.element_at(F.array(*[F.lit(x) for x in options]), rank % len(options) + 1)
    ranked = sizes.select("skey", "source_size", pick(weights).alias("weight"), pick(SLOPES).alias("slope"))
    by_ratio = Window.orderBy((F.lit(float(cap)) * F.col("source_size") / F.col("weight")), "skey")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * F.lit(float(cap)), F.col("_level"))
    first = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("_share", first * F.col("weight")).select(
        "skey", "source_size", "weight", "slope", F.least(F.col("source_size") * F.lit(float(cap)), F.col("_share")).alias("target")
    )


def _time(start: Column, target: Column, slope: Column) -> Column:
    """When demand target * (t + slope * (t * t - t)) reaches ``start``."""
    u = start / target
    rise = F.lit(1.0) - slope
    curved = (F.sqrt(rise * rise + slope * u * 4) - rise) / (slope * 2)
    return F.when(F.abs(slope) < 1e-9, u).otherwise(curved)


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with __ms_skey, and __ms_order, which tells documents by id and text and puts each source in a seeded order."""
    told = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return docs.withColumn("__ms_skey", source_key(F.col("source"))).withColumn("__ms_order", F.md5(told))


def _placed(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """One row per document: __ms_skey, __ms_order, doc_id, size, source_size, target, copies (copy, taken, position)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = _keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "__ms_skey", "__ms_order", size.alias("size"))
    rows = saved(rows, "sizes")  # the texts are read once
    buckets, digits = rows.count() // BUCKET_ROWS, BUCKET_DIGITS
    while 16**digits < buckets:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("__ms_order", 1, digits))
    buckets = rows.groupBy("__ms_skey", "_bucket").agg(F.sum("size").alias("_words"))
    plan = targets(buckets.groupBy(F.col("__ms_skey").alias("skey")).agg(F.sum("_words").alias("source_size")), weights, cap).withColumnRenamed("skey", "__ms_skey")
    before = Window.partitionBy("__ms_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("__ms_skey", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    offsets = offsets.join(plan, "__ms_skey")
    inside = Window.partitionBy("__ms_skey", "_bucket").orderBy("__ms_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["__ms_skey", "_bucket"])
    copies = []
    for copy in range(cap):
        start = F.col("_offset") + F.col("_inside") + F.col("source_size") * copy
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("bigint") - start)).cast("bigint")
        position = F.when(taken > 0, F.abs(_time(start, F.col("target"), F.col("slope"))))  # the very start may come out as a negative zero
        copies.append(F.struct(F.lit(copy + 1).alias("copy"), taken.alias("taken"), position.alias("position")))
    copies = F.filter(F.array(*copies), lambda c: c["taken"] > 0)
    return placed.select("__ms_skey", "__ms_order", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position, copies.

    Words are runs of non-whitespace; a null text has none. A source's documents
    stand in a seeded order of their ids and texts and are read from the start,
    up to ``cap`` times, until the target is met, so a source takes
    floor(target) words exactly and its last copy may be taken in part. Every
    copy has a place of its own: ``copies`` lists (copy, taken, position), where
    ``position`` in [0, 1] is the time at which the source's schedule demands the
    copy's first word. ``taken`` is the sum of a document's copies and
    ``position`` that of the first (null when nothing is taken). Rows that repeat
    an id are separate documents; those that repeat id and text stand next to
    each other. An empty table gives an empty result. Sources are planned in one
    task, one row each.
    """
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda total, c: total + c["taken"])
    return _placed(docs, weights, cap, seed).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"), "copies")


def by_position(mixed: DataFrame) -> DataFrame:
    """Sorted by range of training position; what is not taken comes last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The copies of documents that the mix takes, in training order, with mix_copy (from 1), mix_taken and mix_position.

    A document that is taken three times has three rows. Columns of ``docs``
    with these three names are replaced. Of rows that repeat id, source and text
    one stands for all, as often as they are taken together. Texts are exchanged
    to meet their places and again for the order.
    """
    places = _placed(docs, weights, cap, seed).select("__ms_skey", "__ms_order", F.explode("copies").alias("__ms_c"))
    places = places.select("__ms_skey", "__ms_order", F.col("__ms_c.copy").alias("mix_copy"), F.col("__ms_c.taken").alias("mix_taken"), F.col("__ms_c.position").alias("mix_position"))
    rows = _keyed(docs.drop("mix_copy", "mix_taken", "mix_position"), seed).dropDuplicates(["__ms_skey", "__ms_order"])
    return rows.join(places, ["__ms_skey", "__ms_order"]).drop("__ms_skey", "__ms_order").orderBy("mix_position", "doc_id", "mix_copy")
