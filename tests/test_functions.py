import duckdb
import numpy as np
from pyspark.sql import functions as F

from marlstone.functions import fuzzy
from marlstone.functions import text as T
from marlstone.functions.vector import blend, dot, unit
from marlstone.operators import lexical, recommend, vectors
from marlstone.operators.relational import dense, fuse_ranks, nearest_rank, upsert, z_scores


def test_jaro_winkler_matches_duckdb():
    con, words = duckdb.connect(), ["martha", "marhta", "dixon", "dicksonx", "", "a", "red widget", "red wigdet", "gear"]
    for a in words:
        for b in words:
            assert abs(fuzzy.jaro_winkler(a, b) - con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9 or not (a and b)


def test_ratios():
    assert fuzzy.indel_ratio("kitten", "sitting") == 2 * 4 / 13
    assert fuzzy.indel_ratio("", "") == 1.0 and fuzzy.indel_ratio("a", "") == 0.0
    assert fuzzy.token_set_ratio("red widget", "widget red big") == 1.0
    assert fuzzy.weighted_ratio("red widget", "widget red") >= 0.95
    assert fuzzy.weighted_ratio("gear", "small gear box set") >= 0.85


def test_chunks_and_text(spark):
    words = spark.createDataFrame([(list(map(str, range(1000))),), ([],), (["a", "b", "c"],)], "w array<string>")
    out = words.select(T.chunks(F.col("w"), 380, 50).alias("c")).collect()
    assert [c[0] for c in out[0]["c"]] == ["0", "330", "660", "990"] and len(out[0]["c"][-1]) == 10
    assert out[1]["c"] == [] and out[2]["c"] == [["a", "b", "c"]]
    assert spark.createDataFrame([("Éàü ß",)], "t string").select(T.strip_accents("t")).first()[0] == "Eau ß"


def test_z_scores_of_a_constant(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, None), (3, 2.0, 3.0)], "id int, flat double, x double")
    out = {r["id"]: (r["z_flat"], r["z_x"]) for r in z_scores(df, ["flat", "x"]).collect()}
    assert out == {1: (0.0, -1.0), 2: (0.0, None), 3: (0.0, 1.0)}


def test_rank_fusion_and_percentiles(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int"), spark.createDataFrame([(2, 1), (1, 2)], "id int, rank int")
    got = {r["id"]: r["fused"] for r in fuse_ranks([(a, 1.0), (b, 0.6)], "id").collect()}
    assert abs(got[1] - (1.0 / 20 + 0.6 / 21)) < 1e-12
    xs = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],)], "x array<double>")
    row = xs.select(*[nearest_rank(F.col("x"), 0.5, f).alias(f) for f in ("round", "ceil", "span", "upper")]).first()
    assert tuple(row) == (20.0, 20.0, 30.0, 30.0)


def test_upsert_and_dense(spark):
    old, new = spark.createDataFrame([(1, 10, 10), (2, 10, 10)], "k int, created int, updated int"), spark.createDataFrame([(1, 99, 20)], "k int, created int, updated int")
    assert sorted(map(tuple, upsert(old, new, ["k"], "created", "updated").collect())) == [(1, 10, 20), (2, 10, 10)]
    grid = spark.createDataFrame([("a",), ("b",)], "g string")
    assert sorted(map(tuple, dense(spark.createDataFrame([("a", 3)], "g string, n int"), grid, ["g"], ["n"]).collect())) == [("a", 3), ("b", 0)]


def test_bm25_against_numpy(spark):
    docs = [(0, "red gear red"), (1, "blue gear"), (2, ""), (3, "green widget of red steel")]
    index = lexical.build(spark.createDataFrame(docs, "id int, t string"), "id", "t")
    got = {r["key"]: r["lexical"] for r in lexical.search(index, spark.createDataFrame([(1, "red red gear unknown")], "q int, t string"), "q", "t").collect()}
    tokens = {i: [w for w in t.split() if len(w) > 1] for i, t in docs}
    mean = np.mean([len(t) for t in tokens.values() if t])
    want = {}
    for i, t in tokens.items():
        for term in ("red", "gear"):
            df = sum(term in x for x in tokens.values())
            if term in t:
                idf = np.log(1 + (4 - df + 0.5) / (df + 0.5))
                want[i] = want.get(i, 0) + idf * t.count(term) * 2.5 / (t.count(term) + 1.5 * (0.25 + 0.75 * len(t) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    for block in (7, 2048):
        got = {(r["id"], r["rank"]): r["neighbor"] for r in vectors.nearest(df, "id", "v", 3, block).collect()}
        sims = np.round(x @ x.T, 6)
        np.fill_diagonal(sims, -np.inf)
        assert all(got[i, k + 1] == j for i in range(60) for k, j in enumerate(np.argsort(-sims[i], kind="stable")[:3]))
    row = df.filter("id < 2").agg(F.max_by("v", -F.col("id")).alias("a"), F.max_by("v", "id").alias("b")).select(dot(F.col("a"), F.col("b")).alias("d"), unit(F.col("a"))[0].alias("u"), blend(F.col("a"), F.col("b"), 0.3)[1].alias("m")).first()
    mixed = 0.7 * x[0] + 0.3 * x[1]
    assert np.allclose([row["d"], row["u"], row["m"]], [x[0] @ x[1], x[0][0] / np.linalg.norm(x[0]), mixed[1] / np.linalg.norm(mixed)])


def test_fold_in_solves_the_ridge(spark):
    rng = np.random.default_rng(1)
    q, b = rng.normal(size=(9, 3)), rng.normal(size=9)
    items = spark.createDataFrame([(i, [float(a) for a in v], float(c)) for i, (v, c) in enumerate(zip(q, b, strict=True))], "item_id bigint, qi array<double>, bi double")
    rated = [(5, i, float(rng.integers(1, 10)) / 2) for i in range(6)]
    p = recommend.fold_in(spark.createDataFrame(rated, "user_id bigint, item_id bigint, rating double"), items, 3.0, 0.7).first()["p"]
    y = np.array([r - 3.0 - b[i] for _, i, r in rated])
    assert np.allclose(p, np.linalg.solve(q[:6].T @ q[:6] + 0.7 * np.eye(3), q[:6].T @ y))


def test_interleave_and_diversify():
    # (taken + 1) / weight: 1/2 and 1, so the first list; then 1 and 1, so the first again; then 3/2 and 1, so the second, whose 1 is taken, and its 9
    assert recommend.interleave([[1, 2, 3], [1, 9]], [2.0, 1.0], 4) == [(1, 0), (2, 0), (9, 1), (3, 0)]
    assert recommend.interleave([[], [5]], [1.0, 1.0], 3) == [(5, 1)]
    v = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert recommend.diversify([7, 8, 9], np.array([0.9, 0.89, 0.7]), v, 3) == [7, 9, 8]
