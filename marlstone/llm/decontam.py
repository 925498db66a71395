"""Benchmark decontamination with a broadcast set of normalised n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import tokens
from marlstone.llm.store import saved

WINDOW = 10
#: Words of benchmark text in one broadcast, about 200 MB of windows; a larger benchmark is scanned for in several blocks.
BLOCK_WORDS = 1_000_000
#: Slots of the hash filter for each window: one in 32 of the windows that occur nowhere is looked up for nothing.
_FILTER_SLOTS = 32

FOUND_ARROW = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_words", pa.int64())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())])


class Grams:
    """Windows of the items, by their length in words: a bit filter on hashes, then the exact words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.exact: dict[bytes, tuple[str, ...]] = {}
        self.filters: dict[int, np.ndarray] = {}
        found: dict[bytes, set[str]] = {}
        for item, text in items:
            words = (text or "").encode().translate(tokens.ALNUM_LOWER_BYTES).split()
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                found.setdefault(b" ".join(words[at : at + size]), set()).add(item)
        self.exact = {gram: tuple(sorted(ids)) for gram, ids in found.items()}
        by_size: dict[int, list[bytes]] = {}
        for gram in self.exact:
            by_size.setdefault(gram.count(b" ") + 1, []).append(gram)
        for size, grams in by_size.items():
            run = tokens.Run(np.frombuffer(b" ".join(grams), dtype=np.uint8), np.array([0, sum(map(len, grams)) + len(grams) - 1]), tokens.ALNUM)
            hashes = tokens.windows(run.word_hashes(), size)[::size]
            bits = np.zeros(1 << (len(grams) * _FILTER_SLOTS - 1).bit_length(), dtype=bool)
            bits[hashes & np.uint64(len(bits) - 1)] = True
            self.filters[size] = bits

    def scan(self, run: tokens.Run) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """(text, first word in it, words, items) of every occurrence of a window."""
        hashes, room, text_of = run.word_hashes(), run.room(), run.text_of_word()
        for size, bits in self.filters.items():
            grams = tokens.windows(hashes, size)
            maybe = np.flatnonzero(bits[grams & np.uint64(len(bits) - 1)] & (room[: len(grams)] >= size))
            for at in maybe.tolist():
                words = b" ".join(run.data[run.starts[k] : run.ends[k]].tobytes() for k in range(at, at + size))
                if items := self.exact.get(words):
                    text = int(text_of[at])
                    yield text, at - int(run.first[text]), size, items


def _union(spans: list[int]) -> list[int]:
    """Flat (start, end) pairs, merged where they overlap or touch."""
    pairs = sorted(zip(spans[::2], spans[1::2], strict=True))
    out: list[int] = []
    for start, end in pairs:
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _found(grams: Grams, texts: pa.Array) -> list[dict]:
    rows = [{"spans": [], "items": [], "n_words": 0} for _ in range(len(texts))]
    for at, end, run in tokens.runs(texts, tokens.ALNUM, tokens.LOWER):
        for i, n in enumerate(run.counts().tolist()):
            rows[at + i]["n_words"] = n
        for i, word, size, items in grams.scan(run):
            rows[at + i]["spans"] += [word, word + size]
            rows[at + i]["items"] += items
    for row in rows:
        row["spans"], row["items"] = _union(row["spans"]), sorted(set(row["items"]))
    return rows


def _scanner(grams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("__ms_found", pa.array(_found(grams.value, batch.column("text")), type=FOUND_ARROW))

    return scan


def _block_scanner(grams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, spans, items) of the rows that a block of items hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, x["spans"], x["items"]) for row, x in zip(batch.column("__ms_row").to_pylist(), _found(grams.value, batch.column("text")), strict=True) if x["spans"]]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.string()))], names=["__ms_row", "spans", "items"])

    return scan


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [n for _, _, run in tokens.runs(batch.column("text"), tokens.ALNUM) for n in run.counts().tolist()]
        yield batch.append_column("__ms_words", pa.array(counts, pa.int64()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_union([x for part in parts for x in part]) for parts in batch.column("spans").to_pylist()]
        items = [sorted({x for part in parts for x in part}) for parts in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__ms_row"), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["__ms_row", "spans", "items"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``__ms_found``: hit word spans, their items, the number of words.

    A word of a document is hit if it lies inside an occurrence of ``window``
    consecutive words of an item; an item of fewer words is one window. Items
    without words, and null texts on either side, have none.

    A benchmark over ``block_words`` words is dealt into blocks by item. Each
    block is a job of its own over (row, text) with one block's broadcast, which
    is given up before the next, so memory is one block's however large the
    benchmark; its hits, a few narrow rows, are written to the shared folder and
    joined to the rows at the end. A single item's text is never split.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("words"))
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))
    share = lambda part: spark.sparkContext.broadcast(Grams([(r["item"], r["words"]) for r in part.collect()], window))
    if blocks == 1:
        return docs.mapInArrow(_scanner(share(items)), T.StructType([*docs.schema.fields, T.StructField("__ms_found", FOUND)]))
    items = saved(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "items")
    rows = saved(docs.withColumn("__ms_row", F.monotonically_increasing_id()), "rows")
    shape, hits = "__ms_row bigint, spans array<int>, items array<string>", []
    for block in range(blocks):
        grams = share(items.filter(F.col("block") == block))
        hits.append(saved(rows.select("__ms_row", "text").mapInArrow(_block_scanner(grams), shape), "hits"))
        grams.destroy()
    every = hits[0]
    for part in hits[1:]:
        every = every.unionByName(part)
    every = every.groupBy("__ms_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).mapInArrow(_merged, shape)
    counted = rows.mapInArrow(_counted, T.StructType([*rows.schema.fields, T.StructField("__ms_words", T.LongType())]))
    spans, found = F.coalesce("__ms_spans", F.array().cast("array<int>")), F.coalesce("__ms_items", F.array().cast("array<string>"))
    met = counted.join(saved(every.withColumnsRenamed({"spans": "__ms_spans", "items": "__ms_items"}), "found"), "__ms_row", "left")
    return met.withColumn("__ms_found", F.struct(spans.alias("spans"), found.alias("items"), F.col("__ms_words").alias("n_words"))).select(*docs.columns, "__ms_found")


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Rows that repeat are judged each by itself; an empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    hit = F.expr("aggregate(__ms_found.spans, 0L, (total, x) -> x - total)")  # the spans are flat pairs: ends less starts, as the count is even
    rows = scan(docs.select("doc_id", "text"), benchmark, window, **options)
    return rows.select(
        "doc_id",
        F.col("__ms_found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__ms_found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__ms_found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__ms_found.spans") > 0).alias("contaminated"),
        F.col("__ms_found.spans").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """``docs`` without the documents that a window hits; columns unchanged."""
    return scan(docs, benchmark, window, **options).filter(F.size("__ms_found.spans") == 0).select(*docs.columns)


def _cut(texts, spans):
    import pandas as pd

    out = []
    for text, flat in zip(texts, spans, strict=True):
        if text is None or not len(flat):
            out.append(text)
            continue
        data = text.encode()
        run = tokens.Run(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), tokens.ALNUM)
        kept, at = [], 0
        for start, end in zip(flat[::2], flat[1::2], strict=True):
            kept.append(data[at : run.starts[start]])
            at = run.ends[end - 1]
        out.append(b"".join([*kept, data[at:]]).decode())
    return pd.Series(out, dtype=object)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """``docs`` with the hit words cut out of the texts; columns unchanged, null texts stay null."""
    cut = F.pandas_udf(_cut, T.StringType())
    rows = scan(docs, benchmark, window, **options)
    return rows.withColumn("text", cut("text", "__ms_found.spans")).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
