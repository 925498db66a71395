"""Exact dedup by two Bloom passes; DataFrame functions only.

Pass one marks a bit for every text's hash in a wide, sparse filter and keeps the
bits that two or more rows set; only such rows can have equal texts. Those bits
are put into a second, dense filter of a bounded size, which is broadcast. Pass
two tests each row against it: a row that misses goes straight to the output,
and only the others are shuffled and grouped by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.graph import lookup
from marlstone.llm.store import saved

#: Bits of the sparse filter; two texts out of n share one by chance with a probability of n / 2 ** 48.
SPARSE_BITS = 48
#: The dense filter has this many bits for each bit it holds, and never more than MAX_BITS: 256 MB broadcast.
#: A fuller one lets more unique rows through to the shuffle, whose groups are exact in any case.
BITS_PER_ENTRY = 16
MAX_BITS = 1 << 31
HASHES = 3
#: Bits of a block of the dense filter, that of one ``bitmap_construct_agg``; a row's bits all lie in one.
_BLOCK = 1 << 15


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _sha() -> Column:
    return F.coalesce(F.sha2(_text().cast("binary"), 256), F.lit(""))  # never null, which the optimiser would test on every row


def _row_key(sha: Column, doc_id: Column) -> Column:
    return F.concat(sha, F.coalesce(F.concat(F.lit(":"), doc_id.cast("string")), F.lit("")))


def mark(hashed: str) -> Column:
    """The bit of the sparse filter that a hash sets."""
    return F.col(hashed).bitwiseAND(F.lit((1 << SPARSE_BITS) - 1))


def repeated_marks(keys: DataFrame, hashed: str) -> DataFrame:
    """(mark): bits of the sparse filter that two or more rows set. Copies within a partition are counted before the exchange."""
    marks = keys.select(mark(hashed).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    return saved(marks.filter("n > 1").select("mark"), "marks")


def _places(bit: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a mark in the dense filter, and the places of its bits there."""
    spread = F.xxhash64(bit)
    places = F.array(*[F.shiftrightunsigned(spread, 16 * j).bitwiseAND(F.lit(_BLOCK - 1)) for j in range(HASHES)])
    return F.coalesce(F.pmod(F.xxhash64(bit, F.lit(1)), F.lit(blocks)), F.lit(0)), places


def dense_filter(marks: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """(block, bits) of the dense filter that holds ``marks``, and its number of blocks."""
    wanted = max(_BLOCK, min(max_bits, marks.count() * BITS_PER_ENTRY))
    blocks = -(-wanted // _BLOCK)
    block, places = _places(F.col("mark"), blocks)
    bits = marks.select(block.alias("__ms_block"), F.explode(places).alias("place"))
    return saved(bits.groupBy("__ms_block").agg(F.bitmap_construct_agg("place").alias("__ms_bits")), "bloom"), blocks


def flag_maybe(rows: DataFrame, hashed: str, dense: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``__ms_maybe``: all bits of the row's hash are in the filter. No row is moved."""
    block, places = _places(mark(hashed), blocks)
    rows = rows.withColumn("__ms_block", block).withColumn("__ms_places", places).join(F.broadcast(dense), "__ms_block", "left")
    # byte place / 8 of the bitmap, and of that the bit place % 8
    hit = "(shiftright(cast(conv(hex(substring(__ms_bits, cast(__ms_places[{0}] div 8 as int) + 1, 1)), 16, 10) as int), cast(__ms_places[{0}] % 8 as int)) & 1) = 1"
    every = " AND ".join(hit.format(j) for j in range(HASHES))
    return rows.withColumn("__ms_maybe", F.expr(f"__ms_bits IS NOT NULL AND {every}")).drop("__ms_block", "__ms_places", "__ms_bits")


def annotate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. Of equal texts
    the row with the largest doc_id stays (a null id sorts lowest; of rows that
    agree in both, one stays). Columns other than doc_id and text are not read.
    An empty table gives an empty result.
    """
    rows = docs.select("doc_id", _sha().alias("text_sha256"), F.xxhash64(_text()).alias("__ms_hash"))
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "hashes")
    flagged = flag_maybe(rows, "__ms_hash", *dense_filter(repeated_marks(rows, "__ms_hash"), max_bits))
    unique = flagged.filter("not __ms_maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.filter("__ms_maybe")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    repeated = lookup(maybe, groups, "text_sha256", "group_size", rows.count()).select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "text_sha256"
    )
    return unique.unionByName(repeated)


def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without all but one row of each text, columns unchanged.

    Which row stays is as in ``annotate``. Texts meet nothing but the broadcast
    filter: rows that it clears stay where they are at any size, and of the
    others repeats of (id, text) collapse before they are exchanged.
    """
    hashed = docs.withColumn("__ms_hash", F.xxhash64(_text()))
    keys = saved(hashed.select("doc_id", _sha().alias("__ms_sha"), "__ms_hash"), "hashes")
    dense, blocks = dense_filter(repeated_marks(keys, "__ms_hash"), max_bits)
    keep = flag_maybe(keys, "__ms_hash", dense, blocks).filter("__ms_maybe").groupBy("__ms_sha").agg(F.max("doc_id").alias("__ms_keep_id"))
    keep = keep.select(_row_key(F.col("__ms_sha"), F.col("__ms_keep_id")).alias("__ms_key"))
    flagged = flag_maybe(hashed, "__ms_hash", dense, blocks).drop("__ms_hash")
    maybe = flagged.filter("__ms_maybe").withColumn("__ms_key", _row_key(_sha(), F.col("doc_id"))).dropDuplicates(["__ms_key"])
    stays = maybe.join(keep, "__ms_key", "left_semi")
    return flagged.filter("not __ms_maybe").select(*docs.columns).unionByName(stays.select(*docs.columns))
