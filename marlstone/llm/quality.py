"""Quality classifier: Bradley-Terry ranking of documents by pairwise preferences.

Every preference pair is a document labelled good against one labelled bad. The
chance that the first is preferred is the logistic function of the difference of
their scores, a linear function of features of the text; the weights minimise
the logistic loss on feature differences over all such pairs. The pull of all
pairs on a document depends on its score and the other label's scores only, so
it is taken from their histogram, and a step costs one look at each document.
The decision threshold is the quantile of the training scores at the share of
bad labels, so as many training documents fall below it as are labelled bad.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import tokens
from marlstone.llm.store import saved

#: Labelled documents that are fitted in the driver; their features are about 10 MB. Of more, all are fitted where they lie,
#: and this many only give the start and the first curvature of the steps.
SAMPLE = 20_000
#: Preference pairs that are written out; of more, so many give the start, and the steps that follow are those of all pairs.
PAIRS = 100_000
#: Labelled ids up to which they are broadcast to the texts; more meet the features by exchange.
BROADCAST = 1 << 20
#: The histogram of scores: bins of 1/16 from -64 to 64, each with its own mean.
REACH, BINS = 64.0, 2048
RIDGE = 1e-3
NEWTON_STEPS = 25
SEED = 7

_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASSES = {
    "upper": (tokens._BYTE >= 0x41) & (tokens._BYTE <= 0x5A),
    "lower": (tokens._BYTE >= 0x61) & (tokens._BYTE <= 0x7A),
    "digit": (tokens._BYTE >= 0x30) & (tokens._BYTE <= 0x39),
    "control": (tokens._BYTE < 0x20) & (tokens._BYTE != 0x0A),
    "lines": tokens._BYTE == 0x0A,
    "space": tokens._BYTE == 0x20,
    "wide": tokens._BYTE >= 0x80,
    "marks": np.isin(tokens._BYTE, _PUNCTUATION),
}
NAMES = [
    *_CLASSES,
    *(f"mark_{b:02x}" for b in _PUNCTUATION),
    "no_words", "log_words", "word_bytes", "word_spread", "distinct", "distinct_pairs", "same_next", "most_common", "short_words", "long_words", "repeated_tail",
]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct hashes, and how often its most common one occurs."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    sizes, most = np.diff(starts, append=len(owner)), np.zeros(n)
    np.maximum.at(most, owner[starts], sizes)
    return np.bincount(owner[starts], minlength=n).astype(float), most


def features(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text: shares of kinds of bytes, and how words vary and repeat."""
    out = np.zeros((len(column), len(NAMES)))
    for at, end, run in tokens.runs(column, tokens.SPACED):
        n = end - at
        size = np.maximum(np.diff(run.offsets), 1).astype(float)
        text_of_byte = np.repeat(np.arange(n), np.diff(run.offsets))
        counts = np.bincount(text_of_byte * 256 + run.raw, minlength=n * 256).reshape(n, 256)
        shares = [counts[:, kind].sum(axis=1) / size for kind in _CLASSES.values()]
        marks = [np.log1p(1000 * counts[:, b] / size) for b in _PUNCTUATION]
        words = run.counts().astype(float)
        some = np.maximum(words, 1)
        owner, hashes = run.text_of_word(), tokens.segment_hashes(tokens.LOWER[run.raw], run.starts, run.ends)
        length = (run.ends - run.starts).astype(float)
        mean = _per_text(length, run.first) / some
        spread = np.sqrt(np.maximum(_per_text(length**2, run.first) / some - mean**2, 0))
        distinct, most = _distinct(owner, hashes, n)
        two = tokens.windows(hashes, 2)
        inside = np.flatnonzero(run.room()[: len(two)] >= 2)
        pairs, _ = _distinct(owner[inside], two[inside], n)
        same = np.zeros(len(hashes))
        same[inside] = hashes[inside] == hashes[inside + 1]
        half = run.room() * 2 <= words[owner]
        tail, _ = _distinct(owner[half], hashes[half], n)
        late = np.maximum(np.bincount(owner[half], minlength=n), 1)
        out[at:end] = np.column_stack([
            *shares, *marks, words == 0, np.log1p(words), np.log1p(mean), np.log1p(spread), distinct / some, pairs / np.maximum(some - 1, 1),
            _per_text(same, run.first) / some, most / some, _per_text(length <= 3, run.first) / some, _per_text(length > 20, run.first) / some, tail / late,
        ])
    return out


@dataclass(frozen=True)
class Model:
    """score = logistic(slope . (features - centre) - threshold)."""

    centre: np.ndarray
    slope: np.ndarray
    threshold: float
    curve: np.ndarray | None = None  # of the loss, by standardised features

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = (x - self.centre) @ self.slope - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _histogram(scores: np.ndarray, good: np.ndarray) -> np.ndarray:
    """(label, bin, number and sum of scores)."""
    bins = np.clip((scores + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64) + BINS * good
    return np.stack([np.bincount(bins, minlength=2 * BINS), np.bincount(bins, scores, 2 * BINS)], axis=1).reshape(2, BINS, 2)


def _forces(histogram: np.ndarray) -> np.ndarray:
    """(label, node): what all pairs of a document with this label and score pull it by; bad ones down, good ones up."""
    nodes = np.linspace(-REACH, REACH, BINS + 1)[:, None]
    n = histogram[0, :, 0].sum() * histogram[1, :, 0].sum()
    out = []
    for sign, other in ((1, 1), (-1, 0)):
        count, total = histogram[other].T
        some = count > 0
        out.append((1 / (1 + np.exp(np.clip(sign * (total[some] / count[some] - nodes), -500, 500)))) @ count[some] * sign / n)
    return np.stack(out)


def _pulled(z: np.ndarray, scores: np.ndarray, good: np.ndarray, forces: np.ndarray) -> np.ndarray:
    nodes = np.linspace(-REACH, REACH, BINS + 1)
    return z.T @ np.where(good, np.interp(scores, nodes, forces[1]), np.interp(scores, nodes, forces[0]))


def _descend(w: np.ndarray, curve: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int = 60) -> np.ndarray:
    """Quasi-Newton steps from ``w``, with a first curvature, to where the gradient is zero."""
    inverse, g = np.linalg.inv(curve), gradient(w)
    for _ in range(steps):
        step = -inverse @ g
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w, last = w + step, g
        if np.abs(step).max() < 1e-5:
            break
        g = gradient(w)
        y = g - last
        if (sy := step @ y) > 1e-14:
            left = np.eye(len(w)) - np.outer(step, y) / sy
            inverse = left @ inverse @ left.T + np.outer(step, step) / sy
    return w


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """Newton's method on the logistic loss of (good - bad) differences; with one label only, every score is 0.5.

    More than ``pairs`` pairs are not written out: a draw of them gives the start, and steps by the gradient of all pairs follow.
    """
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Model(np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    z = np.where(scale > 1e-9, (x - centre) / np.maximum(scale, 1e-9), 0.0)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(up) * len(down))
    if n < pairs:
        first, second = np.repeat(up, len(down)), np.tile(down, len(up))
    else:  # every document takes part: both sides are dealt in whole shuffled rounds
        first, second = (np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n] for side in (up, down))
    d = z[first] - z[second]
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the chance of the other order
        gradient = RIDGE * w - d.T @ p / n
        hessian = (d.T * (p * (1 - p))) @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    if n < len(up) * len(down):
        w = _descend(w, hessian, lambda w: RIDGE * w + _pulled(z, z @ w, good, _forces(_histogram(z @ w, good))))
    ranked = z @ w
    threshold = float(np.quantile(ranked, len(down) / len(x), method="midpoint"))
    return Model(centre, np.where(scale > 1e-9, w / np.maximum(scale, 1e-9), 0.0), threshold, hessian)


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(x, good)`` over the batches of (x, good); one array a task goes to the driver."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = part(x, batch.column("good").to_numpy(zero_copy_only=False).astype(bool))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int64()))], names=["sums", "shape"])

    got = rows.select("x", "good").mapInArrow(one, "sums binary, shape array<bigint>").collect()
    parts = [np.frombuffer(r["sums"]).reshape(r["shape"]) for r in got]
    return np.sum([parts[i] for i in sorted(range(len(parts)), key=lambda i: got[i]["sums"])], axis=0)  # whatever order they came in


def fit_where_they_lie(rows: DataFrame, start: Model) -> Model:
    """``fit`` of all (x, good), a table that the tasks read once for each sum; ``start`` is where the steps begin, and bears on nothing else."""
    n_bad, n_good = _summed(rows, lambda x, good: np.array([(~good).sum(), good.sum()]))
    if not n_bad or not n_good:
        return Model(np.zeros(len(NAMES)), np.zeros(len(NAMES)), 0.0)
    centre = _summed(rows, lambda x, good: x.sum(axis=0)) / (n_bad + n_good)
    spread = _summed(rows, lambda x, good: (x - centre).T @ (x - centre)) / (n_bad + n_good)
    scale = np.sqrt(np.diag(spread))
    by = np.where(scale > 1e-9, 1 / np.maximum(scale, 1e-9), 0.0)

    def gradient(w: np.ndarray) -> np.ndarray:
        slope = by * w
        forces = _forces(_summed(rows, lambda x, good: _histogram((x - centre) @ slope, good)))
        return RIDGE * w + by * _summed(rows, lambda x, good: _pulled(x - centre, (x - centre) @ slope, good, forces))

    # without a start: a bound of the curvature
    curve = spread * np.outer(by, by) / 2 + RIDGE * np.eye(len(by)) if start.curve is None else start.curve
    slope = by * _descend(start.slope * scale, curve, gradient)
    # the two scores that the quantile lies between
    at = (n_bad + n_good - 1) * n_bad / (n_bad + n_good)
    threshold = np.mean([_nth(rows, centre, slope, int(k)) for k in (np.floor(at), np.ceil(at))])
    return Model(centre, slope, float(threshold))


def _nth(rows: DataFrame, centre: np.ndarray, slope: np.ndarray, k: int, bins: int = 1 << 12, rounds: int = 5) -> float:
    """The k-th smallest score, from 0: histograms of ever narrower ranges, the last some 1e-14 wide."""
    low, width, before = -REACH * 16, REACH * 32, 0
    for _ in range(rounds):

        def counted(x: np.ndarray, good: np.ndarray, low: float = low, width: float = width) -> np.ndarray:
            at = np.floor(((x - centre) @ slope - low) * (bins / width))
            return np.bincount(np.clip(at, -1, bins).astype(np.int64) + 1, minlength=bins + 2)

        up_to = np.cumsum(_summed(rows, counted))
        bin_ = int(np.clip(np.searchsorted(up_to, k, side="right") - 1, 0, bins - 1))
        low, width = low + bin_ * (width / bins), width / bins
    return low + width / 2


def fold() -> Column:
    """crc32 of the id's text, modulo 3; remainder 1 is held out. Null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def _features_frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "th", "good")), lists], names=["doc_id", "th", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, broadcast: int = BROADCAST, **options: int) -> Model:
    """Fits every labelled document outside the held-out fold: in the driver up to ``sample`` of them, else where they lie.

    Several labels of a document count as good if half of them are; null labels are left out. Of rows that repeat a
    labelled id, the one whose text hashes lowest is fitted.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    chosen = saved(chosen, "labels")
    kind, few = docs.schema["doc_id"].dataType.simpleString(), chosen.count() <= broadcast
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # texts are not exchanged: of many labels, the features of all rows are
    rows = rows.join(F.broadcast(chosen), "doc_id") if few else rows.filter(fold() != 1).withColumn("good", F.lit(None).cast("boolean"))
    found = rows.select("doc_id", "th", "good", "text").mapInArrow(_features_frame, f"doc_id {kind}, th bigint, good boolean, x array<double>")
    found = found if few else found.drop("good").join(chosen, "doc_id")
    found = saved(found.groupBy("doc_id").agg(F.min(F.struct("th", "good", "x")).alias("one")).select("doc_id", "one.good", "one.x"), "features")
    many = found.count() > sample
    some = (found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) if many else found).select("good", "x").toArrow()
    x = some.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    good = some.column("good").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((*x.T[::-1], good))  # the same fit whatever order the rows came in
    model = fit(x[order], good[order], **options)
    return fit_where_they_lie(found, model) if many else model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__ms_score``; null texts are scored as empty ones."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("__ms_score", pa.array(model.scores(features(batch.column("text")))))

    return docs.mapInArrow(per_batch, T.StructType([*docs.schema.fields, T.StructField("__ms_score", T.DoubleType())]))


def annotate(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Only the text is scored. Rows that repeat return each; a null id is not held
    out. An empty table gives an empty result; without labels of both kinds every
    score is 0.5.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), F.col("__ms_score").alias("score"), (F.col("__ms_score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """``docs`` that the classifier accepts (score at least 0.5); columns unchanged."""
    return score(docs, train(docs, labels, **options)).filter("__ms_score >= 0.5").select(*docs.columns)
