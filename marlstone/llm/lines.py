"""Line dedup: winnowing over line hashes.

A text is a sequence of lines. Of every ``SPAN`` consecutive hashes of ``GRAM``
lines the smallest is selected, so any run of ``SPAN + GRAM - 1`` equal lines,
wherever it stands, selects the same fingerprint in it. Fingerprints that occur
again are joined by position, and each is extended both ways to every window of
that many lines that holds it; a window that occurs earlier too is deleted.
Windows that overlap make up the maximal repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.exact import dense_filter, flag_maybe, mark
from marlstone.llm.graph import lookup
from marlstone.llm.store import saved

GRAM = 2
SPAN = 2
_NO_ID = np.iinfo(np.int64).max


def selected(hashes: np.ndarray, owners: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the smallest (of ties the last) of each ``span`` hashes with one owner."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best = np.arange(n)
    for step in range(1, span):
        other = np.arange(n) + step
        best = np.where(hashes[other] <= hashes[best], other, best)
    return np.unique(best[owners[:n] == owners[span - 1 :]])


class Lines:
    """The lines of a run of texts: without outer white space, blank ones left out."""

    def __init__(self, run: tokens.Run):
        text_of = run.text_of_word()
        breaks = np.cumsum(run.raw == 0x0A)
        line = breaks[run.starts] if len(run.starts) else np.empty(0, dtype=np.int64)
        new = np.ones(len(run.starts), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (text_of[1:] != text_of[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(run.starts)) - 1 if len(first) else first
        self.text_of = text_of[first]
        self.hashes, self.more = (tokens.segment_hashes(run.raw, run.starts[first], run.ends[last], point) for point in (0, 1))
        self.begin = np.searchsorted(self.text_of, np.arange(len(run.offsets)))
        self.place = np.arange(len(first)) - self.begin[self.text_of]
        self.room = self.begin[self.text_of + 1] - np.arange(len(first))


def _fingerprints(batches: Iterator[pa.RecordBatch], gram: int, span: int) -> Iterator[pa.RecordBatch]:
    window = gram + span - 1
    for batch in batches:
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        ths = batch.column("th").to_numpy(zero_copy_only=False)
        for at, end, run in tokens.runs(batch.column("text"), tokens.SPACED):
            lines = Lines(run)
            docs, marks = ids[at:end][lines.text_of], ths[at:end][lines.text_of]
            grams = tokens.windows(lines.hashes, gram)
            whole = np.flatnonzero(lines.room[: len(grams)] >= gram)
            picks = whole[selected(grams[whole], lines.text_of[whole], span)]
            wide = tokens.windows(lines.hashes, window)
            more = tokens.windows(lines.more, window, 1)
            # the windows that hold the fingerprint, as far as the text goes both ways
            starts = picks[:, None] + np.arange(gram - window, 1)[None, :]
            rows = np.broadcast_to(picks[:, None], starts.shape)
            lowest = lines.begin[lines.text_of[rows]] if len(picks) else starts
            fits = (starts >= lowest) & (starts < len(wide))
            rows, starts = rows[fits], starts[fits]
            fits = lines.room[starts] >= window
            rows, starts = rows[fits], starts[fits]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[rows].view(np.int64)), pa.array(docs[rows]), pa.array(marks[rows]), pa.array(wide[starts].view(np.int64)), pa.array(more[starts].view(np.int64)), pa.array(lines.place[starts].astype(np.int32)), pa.array(lines.place[rows].astype(np.int32))],
                names=["h", "doc", "th", "w", "v", "at", "pos"],
            )


def repeated_windows(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(doc, th, at): where a window of lines begins that also begins earlier, in a smaller doc_id or further up; th tells the texts of a repeated id apart."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    places = saved(texts.mapInArrow(lambda it: _fingerprints(it, gram, span), "h bigint, doc bigint, th bigint, w bigint, v bigint, at int, pos int"), "lines")
    total = places.count()
    # a fingerprint comes with each window that holds it, so it is repeated if it has two places
    again = places.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("pos").alias("up"), F.max("pos").alias("down"), F.count("*").alias("copies"))
    again = again.filter("low <> high or up <> down").select("h", "copies")
    windows = lookup(places, again, "h", "copies", total).select("doc", "th", "w", "v", "at").distinct()
    firsts = windows.groupBy("w", "v").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = firsts.select("w", F.col("v").alias("first_v"), "first", "copies")
    found = lookup(windows, firsts, "w", "copies", total).filter("v = first_v")
    return found.filter(F.struct("doc", "at") > F.col("first")).select("doc", "th", "at")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_gone = [], [], []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            parts = (text or "").encode().split(b"\n")
            units = [i for i, part in enumerate(parts) if part.strip()]
            gone = {k for at in starts or () for k in range(at, at + window)}
            lost = {units[k] for k in gone}
            kept.append(text if not lost else b"\n".join(p for i, p in enumerate(parts) if i not in lost).decode())
            n_lines.append(len(units))
            n_gone.append(len(lost))
        batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(kept, type=batch.schema.field("text").type))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])


def deduplicated(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(doc_id, text, n_lines, n_removed), the text without its later repeated runs of ``gram + span - 1`` lines or more.

    Lines end at a line feed and are compared without outer ASCII white space;
    blank lines count for nothing and stay. Of equal runs the first by (doc_id,
    line) stays, so a text's own repeats go too. Runs are judged on the input and
    compared by two independent hashes of 61 bits, polynomials modulo a prime. Rows that repeat an id are one document to each
    other; a null id counts as larger than all others; a null text stays null.
    An empty table gives an empty result; other columns are not read.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(int(_NO_ID))), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).withColumn("__ms_key", key)
    starts = repeated_windows(docs, gram, span).groupBy("doc", "th").agg(F.collect_set("at").alias("starts"))
    starts = saved(starts.withColumn("__ms_mark", F.xxhash64("doc", "th")), "runs")
    # only texts that lose lines meet their starts; the broadcast filter lets the others stay where they are
    flagged = flag_maybe(rows, "__ms_key", *dense_filter(starts.select(mark("__ms_mark").alias("mark"))))
    same = (F.coalesce(F.col("doc_id"), F.lit(int(_NO_ID))) == F.col("doc")) & (F.xxhash64("text") == F.col("th")) & (F.col("__ms_key") == F.col("__ms_mark"))
    cut = flagged.filter("__ms_maybe").join(starts.hint("merge"), same, "left").select("doc_id", "text", "starts")
    rows = flagged.filter("not __ms_maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts")).unionByName(cut)
    return rows.mapInArrow(lambda it: _cut(it, gram + span - 1), "doc_id bigint, text string, n_lines bigint, n_removed bigint")


def annotate(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the remaining text; null counts as empty)."""
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return deduplicated(docs, gram, span).select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))
