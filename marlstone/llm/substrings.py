"""Substring dedup by fixed-block anchors.

A window of 50 words always holds one whole block of 25 of its own text's
non-overlapping blocks, wherever it begins. So if it also occurs elsewhere, the
other place's rolling 25-word windows hit that block, and the other way round.
The plan has three passes over the texts, each a Python stage on Arrow data:

1. every rolling 25-word window probes the index of blocks. Probes and blocks
   meet by ranges of their hash; each hash with a block of one document and a
   probe of another is a hit, told to the documents that have it;
2. hits are extended: every 50-word window that holds a hit is hashed again, and
   the smallest doc_id that has it is found by ranges of that hash;
3. windows that a smaller doc_id has are joined to maximal repeats, whose words
   go.

Messages between passes are packed arrays, one row for a batch and an address,
so a word costs about five bytes of shuffle. What a batch can settle itself (a
passage that many of its documents share) it settles, and sends one message for
it: no hash, however common, brings more messages than there are batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens

WINDOW = 50
#: Addresses a shuffle partition (messages between addresses grow with their square), and the text in one of them at most on average.
ADDRESSES = 1
ADDRESS_BYTES = 16 << 20

#: Bytes of text worked on at once: twice the usual, as a run sends a message to each address.
RUN_BYTES = 2 * tokens.RUN_BYTES

_MESSAGE = "addr int, body binary"
_LOW = np.uint64((1 << 31) - 1)
_NO_ID = np.iinfo(np.int64).max


def _pack(*columns: np.ndarray) -> bytes:
    """Equally long integer columns, the first ascending; it is stored as small differences."""
    first, *rest = columns
    steps = np.diff(first, prepend=first[:1])
    kind = next((k for k, top in ((np.uint8, 1 << 8), (np.uint16, 1 << 16), (np.uint32, 1 << 32)) if not len(steps) or (steps.max() < top and steps.min() >= 0)), np.int64)
    head = np.array([len(first), np.dtype(kind).itemsize, first[0] if len(first) else 0], dtype=np.int64)
    return b"".join([head.tobytes(), steps.astype(kind).tobytes(), *(c.tobytes() for c in rest)])


def _unpack(bodies: list[bytes], kinds: tuple) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)], *[[np.empty(0, dtype=k)] for k in kinds]]
    for body in bodies:
        n, width, start = np.frombuffer(body, dtype=np.int64, count=3).tolist()
        kind, at = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width], 24
        parts[0].append(np.cumsum(np.frombuffer(body, dtype=kind, count=n, offset=at).astype(np.int64)) + start)
        at += n * width
        for k, dtype in enumerate(kinds, 1):
            parts[k].append(np.frombuffer(body, dtype=dtype, count=n, offset=at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(p) for p in parts]


def _bodies(addresses: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One body for each address; the columns' rows are put in the order of the first."""
    order = np.lexsort((columns[0], addresses))
    addresses, columns = addresses[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(addresses)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(addresses)], strict=True):
        if b > a:
            yield int(addresses[a]), _pack(*(c[a:b] for c in columns))


def _groups(sorted_keys: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.ones(len(sorted_keys), dtype=bool)
    if len(sorted_keys):
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        for other in more:
            new[1:] |= other[1:] != other[:-1]
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.repeat(values, np.diff(starts, append=n))


def _owned(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One 64-bit value for a document and a key."""
    return tokens.scramble(tokens.scramble(docs.view(np.uint64)) ^ keys.astype(np.uint64))


class Layout:
    """Where messages go: hashes by range to addresses from 0, documents to the addresses after those."""

    def __init__(self, addresses: int, window: int):
        self.n, self.window, self.block = addresses, window, (window + 1) // 2
        self.width = -(-(1 << 64) // addresses)

    def of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(hashes // np.uint64(min(self.width, (1 << 64) - 1)), np.uint64(self.n - 1)).astype(np.int64)

    def of_doc(self, docs: np.ndarray) -> np.ndarray:
        return (tokens.scramble(docs.view(np.uint64)) % np.uint64(self.n)).astype(np.int64)

    def key(self, hashes: np.ndarray) -> np.ndarray:
        """The part of a block hash that is sent: its address and 31 of its bits."""
        return (self.of_hash(hashes) << 31) | (hashes & _LOW).astype(np.int64)

    def runs(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, tokens.Run, np.ndarray]]:
        """(first text, doc_id of each word, run, hash of each word)."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        docs = ids.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for at, end, run in tokens.runs(texts, tokens.SPACED, limit=RUN_BYTES):
            yield at, docs[at:end][run.text_of_word()], run, run.word_hashes()

    # pass 1
    def probe(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, docs, run, words in self.runs(batch.column("doc_id"), batch.column("text")):
                yield _messages(self._probes(docs, run, words))

    def _probes(self, docs: np.ndarray, run: tokens.Run, words: np.ndarray) -> Iterator[tuple[int, bytes]]:
        hashes = tokens.windows(words, self.block)
        at = np.flatnonzero(run.room()[: len(hashes)] >= self.block)
        place = at - run.first[run.text_of_word()[at]]
        hashes, docs, block = hashes[at], docs[at], place % self.block == 0
        order = np.argsort(hashes)
        hashes, docs, block = hashes[order], docs[order], block[order]
        starts = _groups(hashes)
        if not len(starts):
            return
        n = len(hashes)
        low, high = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)
        indexed = np.logical_or.reduceat(block, starts)
        known = _spread(starts, n, (low != high) & indexed)
        # a hit within the batch: tell its documents, and send one of its blocks on
        hit = np.flatnonzero(known)
        yield from self._told(docs[hit], self.key(hashes[hit]))
        first_block = np.full(len(starts), -1)
        blocks = np.flatnonzero(block)[::-1]
        first_block[np.searchsorted(starts, blocks, side="right") - 1] = blocks
        alone = _spread(starts, n, (low == high) & (np.diff(starts, append=n) > 1))
        send = ~known & ~alone
        send[first_block[(low != high) & indexed]] = True
        # a hash that one document repeats is sent once, as a block if it is one anywhere
        single = (low == high) & (np.diff(starts, append=n) > 1)
        send[np.where(indexed, first_block, starts)[single]] = True
        hashes, docs, block = hashes[send], docs[send], block[send]
        yield from _bodies(self.of_hash(hashes), docs, ((hashes & _LOW).astype(np.uint32) << np.uint32(1)) | block.astype(np.uint32))

    def _told(self, docs: np.ndarray, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Messages for documents, each (document, key) once."""
        if len(docs):
            _, once = np.unique(_owned(docs, keys), return_index=True)
            docs, keys = docs[once], keys[once]
            yield from _bodies(self.of_doc(docs) + self.n, docs, keys.view(np.uint64), *(m[once] for m in more))

    # between passes 1 and 2
    def meet(self, key: tuple, table: pa.Table) -> pa.Table:
        addr, bodies = key[0].as_py(), table.column("body").to_pylist()
        if addr >= self.n:  # for documents already
            return _message_table((addr - self.n, body) for body in bodies)
        docs, sent = _unpack(bodies, (np.uint32,))
        low, block = sent >> np.uint32(1), (sent & np.uint32(1)).astype(bool)
        order = np.argsort(low, kind="stable")
        low, block, docs = low[order], block[order], docs[order]
        starts = _groups(low)
        if not len(starts):
            return _message_table([])
        several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
        hit = _spread(starts, len(low), several & np.logical_or.reduceat(block, starts))
        keys = (np.int64(addr) << 31) | low[hit].astype(np.int64)
        return _message_table((a - self.n, body) for a, body in self._told(docs[hit], keys))

    # pass 2
    def extend(self, key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        """Hashes of the windows that hold a hit, to the addresses of their hash."""
        owners, keys = _unpack(told.column("body").to_pylist(), (np.uint64,))
        if not len(owners) or not len(rows):
            return _message_table([])
        wanted = np.unique(_owned(owners, keys))
        out = []
        for docs, run, hashes, more, at in self._candidates(rows, wanted):
            hashes, more, docs = hashes[at], more[at], docs[at]
            order = np.lexsort((more, hashes))
            hashes, more, docs = hashes[order], more[order], docs[order]
            starts = _groups(hashes, more)
            if not len(starts):
                continue
            least = np.minimum.reduceat(docs, starts)
            later = docs > _spread(starts, len(docs), least)
            out += list(self._told(docs[later], hashes[later], more[later]))
            out += list(_bodies(self.of_hash(hashes[starts]), least, hashes[starts], more[starts]))
        return _message_table(out)

    def _windows(self, run: tokens.Run, words: tokens.Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows, independent second ones, and whether they lie in one text."""
        hashes = words.windows(self.window)
        return hashes, tokens.windows(run.word_hashes(1), self.window, 1), run.room()[: len(hashes)] >= self.window

    def _candidates(self, rows: pa.Table, wanted: np.ndarray):
        for _, docs, run, words in self.runs(rows.column("doc_id"), rows.column("text")):
            sums = tokens.Sums(words)
            blocks = sums.windows(self.block)
            hashes, more, whole = self._windows(run, sums)
            if not len(hashes):
                continue
            inside = run.room()[: len(blocks)] >= self.block
            hit = inside & np.isin(_owned(docs[: len(blocks)], self.key(blocks)), wanted)
            hits = np.concatenate([[0], np.cumsum(hit)])
            n, reach = len(hashes), self.window - self.block + 1
            at = np.flatnonzero(whole & (hits[np.minimum(np.arange(n) + reach, len(blocks))] > hits[:n]))
            yield docs, run, hashes, more, at

    # between passes 2 and 3
    def judge(self, key: tuple, table: pa.Table) -> pa.Table:
        addr, bodies = key[0].as_py(), table.column("body").to_pylist()
        if addr >= self.n:
            return _message_table((addr - self.n, body) for body in bodies)
        docs, hashes, more = _unpack(bodies, (np.uint64, np.uint64))
        order = np.lexsort((more, hashes))
        docs, hashes, more = docs[order], hashes[order], more[order]
        starts = _groups(hashes, more)
        if not len(starts):
            return _message_table([])
        later = docs > _spread(starts, len(docs), np.minimum.reduceat(docs, starts))
        return _message_table((a - self.n, body) for a, body in self._told(docs[later], hashes[later], more[later]))

    # pass 3
    def removed_words(self, rows: pa.Table, told: pa.Table) -> Iterator[tuple[int, tokens.Run, np.ndarray]]:
        """(first text, run, whether each word goes)."""
        owners, keys, seconds = _unpack(told.column("body").to_pylist(), (np.uint64, np.uint64))
        wanted, order = np.unique(_owned(owners, keys), return_index=True)
        seconds = seconds[order]
        for at, docs, run, words in self.runs(rows.column("doc_id"), rows.column("text")):
            steps = np.zeros(len(words) + 1, dtype=np.int64)
            if len(wanted):
                hashes, more, whole = self._windows(run, tokens.Sums(words))
                owned = _owned(docs[: len(hashes)], hashes)
                place = np.minimum(np.searchsorted(wanted, owned), len(wanted) - 1)
                begins = np.flatnonzero(whole & (wanted[place] == owned) & (seconds[place] == more))
                np.add.at(steps, begins, 1)
                np.add.at(steps, begins + self.window, -1)
            yield at, run, np.cumsum(steps[:-1]) > 0

    def digest(self, key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, n_words, n_removed, digests, texts = rows.column("doc_id"), [], [], [], []
        for _, run, gone in self.removed_words(rows, told):
            body, first, starts, ends = run.data.tobytes(), run.first.tolist(), run.starts, run.ends
            for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
                lost = int(gone[a:b].sum())
                if lost:
                    left = a + np.flatnonzero(~gone[a:b])
                    kept = b" ".join(body[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True))
                else:
                    kept = b" ".join(body[run.offsets[i] : run.offsets[i + 1]].split())
                n_words.append(b - a)
                n_removed.append(lost)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
        columns = {"doc_id": ids.cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        if self.keep_text:
            return pa.table(columns | {"kept_text": pa.array([t.decode() for t in texts], pa.string())})
        return pa.table(columns | {"kept_sha256": pa.array(digests, pa.string())})

    keep_text = False


def _messages(found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    pairs = list(found)
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], names=["addr", "body"])


def _message_table(found) -> pa.Table:
    return pa.Table.from_batches([_messages(iter(found))])


def _remove(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    addresses = max(ADDRESSES * int(spark.conf.get("spark.sql.shuffle.partitions")), size // ADDRESS_BYTES + 1)
    plan = Layout(addresses, window)
    plan.keep_text = keep_text
    dealt = rows.mapInArrow(lambda it: _dealt(it, plan), "addr int, doc_id bigint, text string")
    probes = rows.mapInArrow(plan.probe, _MESSAGE)
    hits = probes.groupBy("addr").applyInArrow(lambda key, found: plan.meet(key, found), _MESSAGE)
    windows = dealt.groupBy("addr").cogroup(hits.groupBy("addr")).applyInArrow(lambda key, texts, told: plan.extend(key, texts, told), _MESSAGE)
    later = windows.groupBy("addr").applyInArrow(lambda key, found: plan.judge(key, found), _MESSAGE)
    last = "kept_text string" if keep_text else "kept_sha256 string"
    return dealt.groupBy("addr").cogroup(later.groupBy("addr")).applyInArrow(lambda key, texts, told: plan.digest(key, texts, told), f"doc_id bigint, n_words bigint, n_removed bigint, {last}")


def _dealt(batches: Iterator[pa.RecordBatch], plan: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(plan.of_doc(docs), pa.int64()).cast(pa.int32()), *batch.columns], names=["addr", "doc_id", "text"])


def annotate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are runs without ASCII white space, unchanged. A word goes if a window
    of ``window`` consecutive words that covers it also begins in a document with
    a smaller doc_id; windows are judged on the input. Rows that repeat an id are
    one document to each other, so they do not remove each other's words; a null
    id counts as larger than all others. Windows are compared by
    two independent hashes of 61 bits, polynomials of their words modulo a prime.
    An empty table gives an empty result; other columns are not read.
    """
    return _remove(docs, window, keep_text=False)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): as ``annotate`` with the kept words joined by one space."""
    return _remove(docs, window, keep_text=True)
