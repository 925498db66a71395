"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r, every bit position gets a non-zero code of r + 1 bits; for each of
the 2 ** (r + 1) - 1 non-zero vectors v there is a table whose mask takes the
positions whose code has an odd product with v. Any r positions leave a v that
is orthogonal to all their codes, so two fingerprints that differ in at most r
bits are equal under that table's mask: they always share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.graph import components, lookup
from marlstone.llm.store import saved

SHINGLE = 3
RADIUS = 3
SEED = 42
#: A bucket of more fingerprints is split by a second family of masks over the bits it leaves free.
BUCKET = 1024

_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions``: any ``radius`` of them are missed by one mask at least."""
    vectors = (1 << (radius + 1)) - 1
    codes = {p: k % vectors + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p, code in codes.items() if (code & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of one folded text; see ``fingerprints``."""
    joined = b" ".join(text.split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
    starts = [0, *(gaps + 1).tolist()]
    if len(starts) <= size:
        starts, ends = [0], [len(joined)]
    else:
        ends = [*gaps[size - 1 :].tolist(), len(joined)]
        starts = starts[: len(ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
    parts = hashes.view(np.uint8).reshape(-1, 8)
    if len(parts) < 200:
        ones = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int(np.packbits(ones * 2 > len(parts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp), th a hash of the text as it is: A-Z lowered, words between ASCII white space, XXH64 (seed 42) of each run of ``size`` words.

    A bit of fp is set if more than half of the hashes have it. Repeated shingles
    count each time; fewer words make one shingle; no words, or null, give zero.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.utf8(batch.column("text"))
            whole, cuts = data.tobytes().translate(tokens.LOWER_BYTES), offsets.tolist()
            fps = [fingerprint(whole[a:b], size) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(per_batch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, fp bigint")


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Index pairs that join each component of the "at most ``radius`` bits apart" graph; fewer than there are fingerprints."""
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                queue += found
                for other in found:
                    yield at, other


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        flat = members.flatten()
        fps = pc.struct_field(flat, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
        reps = pc.struct_field(flat, "rep").to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(members).to_numpy(zero_copy_only=False)).tolist()
        a, b, at = [], [], 0
        for end in ends:
            for i, j in spanning_links(fps[at:end], radius):
                a.append(reps[at + i])
                b.append(reps[at + j])
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(masks: list[int], at: str, key: str) -> str:
    """SQL for an array of (table, masked fingerprint); as one string, since a column a mask takes the driver seconds to put together."""
    return f"array({', '.join(f"named_struct('{at}', {t}, '{key}', fp & {_signed(m)}L)" for t, m in enumerate(masks))})"


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the reps of distinct fingerprints (rep, fp) that make the graph's components.

    Fingerprints meet in the buckets of the covering tables. A bucket within
    ``bucket`` members is linked in one go. A larger one is dealt by a second
    covering family over the bits that its own mask leaves free; distinct
    fingerprints that agree under both masks differ in about 15 bits only, which
    bounds a bucket of the second level whatever the number of rows. No bucket
    yields more links than members.
    """
    masks = covering_masks(list(range(64)), radius)
    rows = fps.select("rep", "fp", F.explode(F.expr(_keyed(masks, "t", "key"))).alias("k")).select("rep", "fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("members_n")).filter("members_n > 1")
    shared = saved(rows.join(sizes, ["t", "key"]), "buckets")
    member = F.collect_list(F.struct("fp", "rep")).alias("members")
    link = lambda grouped: grouped.select("members").mapInArrow(lambda it: _links(it, radius), "a bigint, b bigint")
    links = link(shared.filter(F.col("members_n") <= bucket).groupBy("t", "key").agg(member))
    large = shared.filter(F.col("members_n") > bucket)
    free = [[p for p in range(64) if not mask >> p & 1] for mask in masks]
    second = F.expr(f"element_at(array({', '.join(_keyed(covering_masks(positions, radius), 't2', 'key2') for positions in free)}), t + 1)")
    dealt = large.select("rep", "fp", "t", "key", F.explode(second).alias("k")).select("rep", "fp", "t", "key", "k.t2", "k.key2")
    return links.unionByName(link(dealt.groupBy("t", "key", "t2", "key2").agg(member)))


def _identity():
    """Orders rows by id, null last; rows that repeat an id are told apart by their text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")


def annotate(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest
    doc_id that links reach. Equal fingerprints (the zero one of wordless texts
    too) are one node, so copies are never paired with one another. Rows that
    repeat an id each return; null ids take part as the smallest non-null id's
    fellows and get that id, or null when their group has no other. An empty
    table gives an empty result.
    """
    rows, labelled, total = _labelled(docs, radius, size)
    labelled = labelled.select("fp", "copies", F.col("keep.doc_id").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return lookup(rows.drop("th"), labelled, "fp", "copies", total).select("doc_id", hexed, "component_id")


def _labelled(docs: DataFrame, radius: int, size: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, th, fp), each fp's copies and the first row of its component (null ids last), the number of rows."""
    rows = saved(fingerprints(docs, size), "simhash")
    total = rows.count()
    nodes = saved(rows.groupBy("fp").agg(F.min(_identity()).alias("rep"), F.count("*").alias("copies")), "nodes")
    found = components(near_links(nodes.select(F.col("fp").alias("rep"), "fp"), radius))
    named = saved(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "rep", "copies", F.coalesce("component", "fp").alias("component")), "named")
    groups = named.groupBy("component").agg(F.min("rep").alias("keep"), F.count("*").alias("members"))
    return rows, lookup(named, groups, "component", "members", total).select("fp", "copies", "keep"), total


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; columns unchanged.

    A row is judged by its id and text: another text under the same id stays, and
    near copies without an id go like others.
    """
    rows, labelled, total = _labelled(docs, radius, size)
    gone = lookup(rows, labelled, "fp", "copies", total).filter(_identity() != F.col("keep"))
    gone = saved(gone.select(F.col("doc_id").alias("__ms_gone"), F.col("th").alias("__ms_th")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__ms_gone"]) & (F.xxhash64(docs["text"]) == gone["__ms_th"]), "left_anti")
