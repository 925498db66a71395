import random
import zlib

import numpy as np
import pyarrow as pa

from marlstone.llm import quality

SCHEMA = "doc_id bigint, text string, score string, quality string"


def fixture(n=400):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(20, 120))
        good = i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [words[0]] * 40
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = fixture()
    rows += [(9000, None), (9001, ""), (9002, "é" * 200_000), (None, "word1 word2")]
    docs, marks = frames(spark, rows, labels)
    out = quality.annotate(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    want = {d: q for d, q, _ in labels}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 3 == 1}
    right = [r["predicted"] == want[r["doc_id"]] for r in held if r["doc_id"] in want]
    assert np.mean(right) > 0.97
    again = quality.annotate(docs.repartition(5), marks).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in out} == {r["doc_id"]: round(r["score"], 9) for r in again}
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[9000] == by_id[9001]


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = fixture()
    docs, marks = frames(spark, rows, labels)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels]
    a, b = quality.train(docs, marks), quality.train(docs, frames(spark, rows, flipped)[1])
    assert np.array_equal(a.slope, b.slope) and a.threshold == b.threshold


def test_one_label_and_empty(spark):
    rows, labels = fixture(40)
    docs, marks = frames(spark, rows, [(d, 1, 0) for d, _, _ in labels])
    assert {r["score"] for r in quality.annotate(docs, marks).collect()} == {0.5}
    assert quality.annotate(docs.limit(0), marks).collect() == []
    kept = quality.drop_rejected(docs, marks.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_rejects_what_it_predicts(spark):
    rows, labels = fixture()
    docs, marks = frames(spark, rows, labels)
    good = {r["doc_id"] for r in quality.annotate(docs, marks).collect() if r["predicted"]}
    assert {r["doc_id"] for r in quality.drop_rejected(docs, marks).collect()} == good


def test_features_do_not_depend_on_the_batch():
    texts = ["a b c", None, "", "X!! X!! X!!", "日本 é\n" * 50, " "]
    whole = quality.features(pa.array(texts))
    single = np.vstack([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single)


def test_repeats_of_a_labelled_id_bring_one_row(spark):
    rows, labels = fixture(40)
    docs, marks = frames(spark, rows, labels)
    chosen = next(d for d, _, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1)
    many = docs.unionByName(spark.range(1000).selectExpr(f"{chosen}L doc_id", "concat('text ', id) text", "'x' score", "'y' quality"))
    fitted, real = [], quality.fit
    quality.fit = lambda x, good, **options: fitted.append(len(x)) or real(x, good, **options)
    try:
        quality.train(many, marks, sample=1)
        quality.train(many, marks)
    finally:
        quality.fit = real
    assert fitted == [1, sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, _, _ in labels)]


def test_weights_minimise_the_pairwise_loss():
    """Every pair written out, plain gradient descent: the same weights as the fit's."""
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(40, 4)), rng.random(40) < 0.6
    x[:, 0] += good
    model = quality.fit(x, good, pairs=10**6)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.array([z[i] - z[j] for i in up for j in down])
    w = np.zeros(4)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(d @ w))
        w -= 0.5 * (quality.RIDGE * w - d.T @ p / len(d))
    fitted = model.slope * x.std(axis=0)
    assert np.allclose(fitted, w, atol=1e-3)
    ranked = z @ fitted
    assert abs(np.mean(ranked < model.threshold) - len(down) / len(x)) <= 1 / len(x)


def test_all_labels_are_fitted_where_they_lie(spark):
    """Few rows only start the steps: the result is that of the fit of all labels, by either way to the labels."""
    rows, labels = fixture(300)
    rng = random.Random(9)
    docs, marks = frames(spark, rows, [(d, q if rng.random() < 0.8 else 1 - q, t) for d, q, t in labels])
    whole = quality.train(docs, marks)
    for options in ({"sample": 20}, {"sample": 20, "broadcast": 0}):
        part = quality.train(docs.repartition(3), marks, **options)
        at = np.random.default_rng(2).random((50, len(quality.NAMES))) * whole.centre
        assert np.allclose(part.scores(at), whole.scores(at), atol=2e-2)
        assert abs(part.threshold - whole.threshold) < 2e-2


def test_the_gradient_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(900, 4)), rng.random(900) < 0.6
    x[:, 0] += good
    written, drawn = quality.fit(x, good, pairs=10**6), quality.fit(x, good, pairs=500)
    assert np.allclose(written.slope, drawn.slope, atol=1e-3) and abs(written.threshold - drawn.threshold) < 1e-2
