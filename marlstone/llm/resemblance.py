"""Near copies by SimHash, checked by the Jaccard similarity of shingle sets.

Fingerprints that differ in at most three bits share a bucket of the covering
tables of ``simhash``. Pairs at a similarity of 0.8 differ in about ten bits, so
MinHash bands widen the candidates: 24 bands of 5 values miss such a pair once
in 13,000 times. What shares a bucket of either kind is compared by its whole
sets, so no pair below the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import simhash, tokens
from marlstone.llm.graph import components, lookup
from marlstone.llm.store import saved

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
SEED = 42
#: Sets that are compared in one task; larger buckets are dealt into parts.
BUCKET = 1024

_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = _FACTORS * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``size`` words.

    A-Z are lowered, words stand between ASCII white space; fewer words make one
    shingle, no words (or null) an empty set.
    """
    for _, _, run in tokens.runs(texts, tokens.SPACED, tokens.LOWER):
        words = run.word_hashes()
        grams = tokens.windows(words, size)
        for a, b in zip(run.first.tolist(), run.first[1:].tolist(), strict=False):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield tokens.windows(words[a:b], b - a) if b > a else words[:0]


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    at = np.arange(0, BANDS * ROWS, ROWS)
    for batch in batches:
        sids, keys = [], []
        data, offsets = tokens.utf8(batch.column("text"))
        whole, cuts = data.tobytes().translate(tokens.LOWER_BYTES), offsets.tolist()
        fps = np.array([simhash.fingerprint(whole[a:b], size) for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.uint64).view(np.int64)
        for found in shingle_sets(batch.column("text"), size):
            sids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            if len(found):
                least = (found * _FACTORS + _SHIFTS).min(axis=1)
                keys.append(tokens.segment_hashes(least, at, at + ROWS).view(np.int64))
            else:
                keys.append(np.empty(0, dtype=np.int64))
        sid = pa.array(np.array(sids, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), sid, pa.array(fps), pa.array(keys, type=pa.list_(pa.int64()))], names=["doc_id", "th", "sid", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x.tobytes() for x in shingle_sets(batch.column("text"), size)]
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(found, type=pa.binary())], names=["sid", "grams"])


def spanning_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Index pairs that join each component of the "at least ``similarity``" graph; fewer than there are sets."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left = np.ones(len(sets), dtype=bool)
    while left.any():
        start = int(np.argmax(left))
        left[start] = False
        queue = [start]
        while queue:
            live = left[owner]
            flat, owner = flat[live], owner[live]
            if not len(flat):
                break
            at = queue.pop()
            place = np.minimum(np.searchsorted(sets[at], flat), sizes[at] - 1)
            common = np.bincount(owner[sets[at][place] == flat], minlength=len(sets))
            near = left & (common >= similarity * (sizes + sizes[at] - common) - 1e-9)
            found = np.flatnonzero(near).tolist()
            left[near] = False
            queue += found
            for other in found:
                yield at, other


def _links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            sids = pc.struct_field(members.values, "sid").to_pylist()
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in pc.struct_field(members.values, "grams")]
            for i, j in spanning_links(sets, similarity):
                a.append(sids[i])
                b.append(sids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def _pivot_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(bucket, a, b): links of a part's members to their bucket's pivot, and (bucket, a, null) for those that are not like it."""
    for batch in batches:
        buckets, a, b = [], [], []
        for bucket, pivot, members in zip(batch.column("bucket").to_pylist(), batch.column("pivot").to_pylist(), batch.column("members"), strict=True):
            sids = pc.struct_field(members.values, "sid").to_pylist()
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in pc.struct_field(members.values, "grams")]
            centre = sets[sids.index(pivot)]
            for sid, found in zip(sids, sets, strict=True):
                if sid == pivot:
                    continue
                place = np.minimum(np.searchsorted(centre, found), len(centre) - 1)
                common = int((centre[place] == found).sum())
                buckets.append(bucket)
                a.append(sid)
                b.append(pivot if common >= similarity * (len(found) + len(centre) - common) - 1e-9 else None)
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (buckets, a, b)], names=["bucket", "a", "b"])


def _linked(grouped: DataFrame, similarity: float) -> DataFrame:
    """Links within each group of (sid, grams)."""
    members = grouped.agg(F.collect_list(F.struct("sid", "grams")).alias("members")).select("members")
    return members.mapInArrow(lambda it: _links(it, similarity), "a bigint, b bigint")


def bucket_links(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that make the components of similar sets within each bucket; ``met`` has bucket, n (its members), pivot, sid and grams.

    A bucket within ``bucket`` members is compared in one go. A larger one is dealt
    into parts of about that size, each with the bucket's pivot. Members like the
    pivot are linked through it, so nothing more is needed between them; the
    others, in blocks of the same size, meet every part. So no task holds more than
    two parts, no similar pair stays unlinked, and copies of one text cost one pass
    however many they are.
    """
    small = _linked(met.filter(F.col("n") <= bucket).groupBy("bucket"), similarity)
    blocks_of = lambda n: F.ceil(F.col(n) / bucket).cast("int")
    large = met.filter(F.col("n") > bucket).withColumn("parts", blocks_of("n"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = large.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    pivots = large.filter("sid = pivot").withColumn("part", every("parts"))
    first = parts.filter("sid <> pivot").unionByName(pivots).groupBy("bucket", "part").agg(F.first("pivot").alias("pivot"), F.collect_list(F.struct("sid", "grams")).alias("members"))
    told = saved(first.select("bucket", "pivot", "members").mapInArrow(lambda it: _pivot_links(it, similarity), "bucket bigint, a bigint, b bigint"), "pivots")
    others = told.filter("b IS NULL").select("bucket", F.col("a").alias("sid"))
    blocks = others.groupBy("bucket").agg(F.count("*").alias("left")).select("bucket", blocks_of("left").alias("blocks"))
    blocks = blocks.join(large.filter("sid = pivot").select("bucket", "parts"), "bucket")  # one row for each large bucket with others
    dealt = others.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int"))
    loose = dealt.withColumn("part", every("parts")).join(sets, "sid").select("bucket", "part", "block", "sid", "grams")
    against = parts.join(blocks.select("bucket", "blocks"), "bucket").withColumn("block", every("blocks")).select("bucket", "part", "block", "sid", "grams")
    both = _linked(loose.unionByName(against).dropDuplicates(["bucket", "part", "block", "sid"]).groupBy("bucket", "part", "block"), similarity)
    return small.unionByName(told.filter("b IS NOT NULL").select("a", "b")).unionByName(both)


def _identity():
    """Orders rows by id, null last; rows that repeat an id are told apart by their text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bucket: int = BUCKET, bands: int = BANDS) -> DataFrame:
    """(doc_id, th) of the rows that go: all but the one of smallest id of each group that similar pairs make.

    Candidates share a covering table's bucket of their SimHash, or one of ``bands`` MinHash bands. Equal sets are one node, so copies are never paired with one another. Buckets
    of the same members, told by their number and two hashes of them, are
    compared once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = saved(texts.mapInArrow(lambda it: _signatures(it, size), f"doc_id {kind}, th bigint, sid bigint, fp bigint, keys array<bigint>"), "signatures")
    total = rows.count()
    nodes = saved(rows.groupBy("sid").agg(F.min(_identity()).alias("rep"), F.count("*").alias("copies"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    tables = F.transform(F.expr(simhash._keyed(simhash.covering_masks(list(range(64))), "t", "key")), lambda k: F.xxhash64(F.lit("simhash"), k["t"], k["key"]))
    kept = F.transform(F.slice("keys", 1, bands), lambda key, band: F.xxhash64(band, key))
    entries = nodes.filter(F.size("keys") > 0).select("sid", F.explode(F.array_distinct(F.concat(tables, kept))).alias("bucket"))
    every = len(simhash.covering_masks(list(range(64)))) + bands
    marks = [F.bit_xor(F.xxhash64("sid", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sid").alias("pivot"), *marks).filter("n > 1")
    shared = saved(shared.dropDuplicates(["n", "pivot", "mark1", "mark2"]).select("bucket", "n", "pivot"), "buckets")
    dealt = saved(lookup(entries, shared, "bucket", "n", total * every), "dealt")
    wanted = nodes.join(dealt.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("rep_id")) & (texts["th"] == F.col("rep_th"))).select("sid", "text")
    sets = saved(chosen.mapInArrow(lambda it: _sets(it, size), "sid bigint, grams binary"), "sets").dropDuplicates(["sid"])
    found = components(bucket_links(dealt.join(sets, "sid"), sets, similarity, bucket))
    named = nodes.join(found, nodes["sid"] == found["node"], "left").select("sid", "rep", "copies", F.coalesce("component", "sid").alias("component"))
    named = saved(named, "named")
    groups = named.groupBy("component").agg(F.min("rep").alias("keep"), F.count("*").alias("members"), F.sum("copies").alias("of")).filter("of > 1").drop("of")
    labelled = saved(lookup(named, groups, "component", "members", total).select("sid", "copies", "keep"), "labelled")
    return lookup(rows.select("doc_id", "th", "sid"), labelled, "sid", "copies", total).filter(_identity() != F.col("keep")).select("doc_id", "th").distinct()


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id; columns unchanged.

    A row is judged by its id and text: another text under the same id stays, and
    near copies without an id go like others. An empty table gives an empty result.
    """
    gone = saved(near_copies(docs, similarity, size, bucket).select(F.col("doc_id").alias("__ms_gone"), F.col("th").alias("__ms_th")), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__ms_gone"]) & (F.xxhash64(docs["text"]) == gone["__ms_th"]), "left_anti")
