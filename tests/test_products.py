"""Best products and groups that stream through, against plain Python."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import evaluation, lexical, recommend, vectors


def brute(x, owner, banned, ids, y, bias, k):
    out = []
    for i in range(len(x)):
        skip = set(banned[owner == i].tolist())
        scored = sorted((-np.round(x[i] @ y[j] + bias[j], 6), int(ids[j])) for j in range(len(ids)) if int(ids[j]) not in skip)
        out += [(i, other, -s) for s, other in scored[:k]]
    return out


def test_best_of_keeps_k_rows_with_ties_copies_and_bans(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(20):
        monkeypatch.setattr(vectors, "TILE", (512, int(rng.integers(5, 60))))
        n, m, d, k = (int(rng.integers(1, hi)) for hi in (20, 200, 5, 8))
        x, y = np.round(rng.normal(size=(n, d)), 1), np.round(rng.normal(size=(m, d)), trial % 3)
        ids, bias = rng.permutation(m * 3)[:m], np.round(rng.normal(size=m), 1) * (trial % 2)
        owner, banned = rng.integers(0, n, 100), rng.integers(0, m * 3, 100)
        rows, others, scores = vectors.best_of(x, owner, banned, vectors.shelf(ids, y, bias), k)
        got = sorted(zip(rows.tolist(), others.tolist(), scores.tolist(), strict=True), key=lambda t: (t[0], -t[2], t[1]))
        want = brute(x, owner, banned, ids, y, bias, k)
        assert [t[:2] for t in got] == [t[:2] for t in want] and np.allclose([t[2] for t in got], [t[2] for t in want], atol=1.1e-6)


def test_groups_are_whole_across_batches(spark, monkeypatch):
    monkeypatch.setattr(recommend, "ROWS", 64)
    df = spark.range(5000).select((F.col("id") * F.col("id") % 97).alias("g"), F.col("id").alias("x"))

    def first_and_size(keys, part, starts, ends):
        x = part.column("x").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(x[starts]), pa.array(np.subtract(ends, starts), pa.int64())], names=["g", "top", "n"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {tuple(r) for r in recommend.by_group(df, "g", [F.col("x").desc()], first_and_size, "g bigint, top bigint, n bigint").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {tuple(r) for r in df.groupBy("g").agg(F.max("x"), F.count("*")).collect()}


def test_a_stored_index_has_more_ranges_for_more_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 50)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(20))) for i in range(60)], "id bigint, text string")
    lexical.build(docs, "id", "text").save(str(tmp_path / "ix"), files=2)
    stored = lexical.load(spark, str(tmp_path / "ix"))
    assert len(list((tmp_path / "ix" / "postings").glob("part-*"))) > 10  # 1,200 postings
    asked = spark.createDataFrame([(1, "w3 w9")], "q int, t string")
    want = {r["key"]: r["lexical"] for r in lexical.search(lexical.build(docs, "id", "text"), asked, "q", "t").collect()}
    got = {r["key"]: r["lexical"] for r in lexical.search(stored, asked, "q", "t").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_batches_are_worked_on_in_short_runs():
    texts = pa.array(["é" * 400_000, None, "", "naïve", "plain"] * 3, pa.string())
    assert text._plain(texts).to_pylist() == [t if t is None else text.without_accents(t) for t in texts.to_pylist()]
    assert text._plain(texts.slice(3, 1)).to_pylist() == ["naive"]


def test_best_ranks_count_what_stands_before(spark):
    rng = np.random.default_rng(4)
    scored = [(q, k, float(rng.integers(0, 5))) for q in range(6) for k in range(30)]
    relevant = [(q, int(k)) for q in range(5) for k in rng.integers(0, 40, 3)]
    got = evaluation.best_ranks(spark.createDataFrame(scored, "qid int, key int, score double"), spark.createDataFrame(relevant, "qid int, key int"))
    want = {}
    for q in range(6):
        order = [k for _, k in sorted((-s, k) for p, k, s in scored if p == q)]
        places = [order.index(k) + 1 for p, k in relevant if p == q and k in order]
        if places:
            want[q] = min(places)
    assert {r["qid"]: r["rank"] for r in got.collect()} == want


def test_strips_lose_no_score_that_reaches_its_bound():
    rng = np.random.default_rng(9)
    for columns in (1, 63, 64, 200):
        s = rng.normal(size=(columns, 7)).astype(np.float32)
        s[rng.random(s.shape) < 0.05] = np.nan
        s[rng.random(s.shape) < 0.05] = -np.inf
        s[rng.random(s.shape) < 0.05] = np.inf
        bound = np.array([-np.inf, -1, 0, 1, 2, np.inf, np.nan], np.float32)
        row, column = vectors._reaching(s, bound)
        assert sorted(zip(row.tolist(), column.tolist(), strict=True)) == sorted((q, c) for q in range(7) for c in range(columns) if s[c, q] >= bound[q] and s[c, q] > -np.inf)
