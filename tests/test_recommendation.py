"""Recommendation plans without SQL, against plain Python over the smallest tables."""

from collections import defaultdict

import numpy as np
import pytest

from marlstone.operators import recommend as R
from marlstone.plans import registry
from marlstone.plans.base import ratings
from marlstone.plans.recommendation import _neighbors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rows = [tuple(r) for r in ratings(spark, SF).select("user_id", "item_id", "rating").collect()]
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    return rows, vectors


def plan(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def profiles(rows, vectors):
    out = defaultdict(dict)
    for u, i, r in rows:
        if r >= 3.0 and i in vectors:
            out[u][i] = max(out[u].get(i, 0), max(0.25, r - 2.5))
    return out


def clusters(profile, vectors):
    items = sorted(profile, key=lambda i: (-profile[i], i))
    x = [vectors[i] / np.linalg.norm(vectors[i]) for i in items]
    k = min(max(round(len(items) / 4), 1), 5, len(items))
    centres = [v.copy() for v in x[:k]]
    nearest = lambda v: max(range(k), key=lambda c: (round(float(v @ centres[c]), 9), -c))
    for _ in range(5):
        near = [nearest(v) for v in x]
        for c in range(k):
            mine = [profile[i] * v for i, v, n in zip(items, x, near, strict=True) if n == c]
            if mine:
                centres[c] = sum(mine) / np.linalg.norm(sum(mine))
    near = [nearest(v) for v in x]
    return {c: (centres[c], sum(profile[i] for i, n in zip(items, near, strict=True) if n == c)) for c in set(near)}


def lists(rows, vectors):
    seen, out = defaultdict(set), {}
    for u, i, _ in rows:
        seen[u].add(i)
    for u, profile in profiles(rows, vectors).items():
        out[u] = {}
        for c, (centre, weight) in clusters(profile, vectors).items():
            scored = sorted(((-round(float(vectors[i] @ centre), 6), i) for i in vectors if i not in seen[u]))[:20]
            out[u][c] = (weight, [(i, -s) for s, i in scored])
    return out


def merged(lists_of_user, n=20):
    names = sorted(lists_of_user)
    taken, at, picked = dict.fromkeys(names, 0), dict.fromkeys(names, 0), []
    while len(picked) < n:
        ready = [c for c in names if at[c] < len(lists_of_user[c][1])]
        if not ready:
            break
        c = min(ready, key=lambda c: ((taken[c] + 1) / lists_of_user[c][0], c))
        item = lists_of_user[c][1][at[c]][0]
        at[c] += 1
        if item not in [p[0] for p in picked]:
            taken[c] += 1
            picked.append((item, c))
    return picked


def test_interests_lists_and_turns(spark, data):
    rows, vectors = data
    want = lists(rows, vectors)
    got = defaultdict(dict)
    for r in plan(spark, "kmeans_interests"):
        got[r["user_id"]][r["interest"]] = r["weight"]
    assert {u: {c: round(w, 6) for c, (w, _) in x.items()} for u, x in want.items()} == got
    turns = defaultdict(list)
    for r in sorted(plan(spark, "weighted_interleave"), key=lambda r: (r["user_id"], r["position"])):
        turns[r["user_id"]].append((r["item_id"], r["interest"]))
    assert turns == {u: merged(x) for u, x in want.items()}


def test_content_and_hybrid(spark, data):
    rows, vectors = data
    content = defaultdict(dict)
    for u, x in lists(rows, vectors).items():
        score = defaultdict(float)
        for _, items in x.values():
            for i, s in items:
                score[i] = max(score.get(i, -9), s)
        left, picked = sorted((i for i, _ in merged(x)), key=lambda i: (-score[i], i)), []
        while left and len(picked) < 10:
            value = [0.72 * score[i] - 0.28 * max((float(vectors[i] @ vectors[j]) for j in picked), default=0.0) for i in left]
            picked.append(left.pop(int(np.argmax(value))))
        content[u] = {i: k for k, i in enumerate(picked, 1)}
    got = defaultdict(dict)
    for r in plan(spark, "profile_content"):
        got[r["user_id"]][r["item_id"]] = r["rank"]
    assert got == content

    near, seen = [tuple(r) for r in _neighbors(spark, SF).select("item_id", "neighbor_id", "sim").collect()], {(u, i) for u, i, _ in rows}
    by_item = defaultdict(list)
    for i, j, s in near:
        by_item[i].append((j, s))
    for r in plan(spark, "profile_hybrid"):
        got[r["user_id"], "h"][r["item_id"]] = r["fused"]
    for u, profile in profiles(rows, vectors).items():
        sums = defaultdict(float)
        for i, w in profile.items():
            for j, s in by_item[i]:
                sums[j] += w * s
        order = sorted((-round(s, 6), j) for j, s in sums.items() if (u, j) not in seen)[:60]
        fused = defaultdict(float)
        for i, k in content[u].items():
            fused[i] += 1.0 / (19 + k)
        for k, (_, j) in enumerate(order, 1):
            fused[j] += 0.5 / (19 + k)
        best = sorted((-round(s, 6), i) for i, s in fused.items())[:10]
        assert [s for s, _ in best] == sorted(-s for s in got[u, "h"].values()), u


def test_every_user_is_scored(spark, data):
    rows, _ = data
    mu = np.mean([r for _, _, r in rows])
    near = {r["item_id"] for r in _neighbors(spark, SF).filter("sim > 0").collect()}
    means = defaultdict(list)
    for u, i, r in rows:
        means[u, i].append(r)
    want = {u for (u, i), r in means.items() if np.mean(r) > mu and i in near}
    assert {r["user_id"] for r in plan(spark, "item_item_scores")} == want


def fold(history, vectors, mu=2.75):
    x = np.array([vectors[i][:8] for i, _ in history])
    y = np.array([r - mu - (i % 7 - 3) / 10 for i, r in history])
    return np.linalg.solve(x.T @ x + np.eye(8), x.T @ y)


def test_fold_in_and_cascade(spark, data):
    rows, vectors = data
    known = defaultdict(list)
    for u, i, r in rows:
        if i in vectors:
            known[u].append((i, r))
    got = {r["user_id"]: (r["p0"], r["p7"]) for r in plan(spark, "ridge_fold_in")}
    want = {u: fold(h, vectors) for u, h in known.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[u], (want[u][0], want[u][7]), atol=2e-6) for u in want)
    out = defaultdict(dict)
    for r in plan(spark, "recommend_cascade"):
        out[r["user_id"], r["way"]][r["rank"]] = r["item_id"]
    users = {r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert {u for u, _ in out} == users and len(out) == len(users)
    for (u, way), items in out.items():
        overlap = len({i for i, _ in known[u]})
        assert way == ("fold_in" if overlap >= 2 else "neighbors" if overlap == 1 else "popular")
        if way == "fold_in":
            scored = sorted((-round(2.75 + 0.5 * (i % 7 - 3) / 10 + float(v[:8] @ want[u]), 6), i) for i, v in vectors.items() if i not in {i for i, _ in known[u]})[:10]
            assert [items[k] for k in range(1, 11)] == [i for _, i in scored], u


def test_factors_beat_the_mean(spark):
    out = plan(spark, "als_residual")[0]
    assert 0 < out["mae"] < out["rmse"] and out["n"] > 500 and abs(out["rmse"] / out["rmse_of_mean"] - 1) < 0.2


def test_ratings_are_joined_once(spark, data):
    """The ratings are put together once: joined, dealt by item, and dealt by the library; not once for each reader."""
    sc, group = spark.sparkContext, "als_residual"
    off = {k: "-1" for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    before = {k: spark.conf.get(k, None) for k in off}
    sc.setJobGroup(group, group)
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan(spark, "als_residual")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteRecords() for i in {i for j in jobs for i in j.stageIds})
    assert len(data[0]) < written < 4 * len(data[0])


@pytest.mark.parametrize("step", [1, 10_000_000])
def test_item_blocks_do_not_change_the_factors(spark, step):
    """Whether items are dealt by range or, if their numbers are too wide, by remainder: as the library by itself."""
    from pyspark.ml.recommendation import ALS
    from pyspark.sql import functions as F

    rated = ratings(spark, SF).select("user_id", (F.col("item_id") * step).alias("item_id"), "rating", (F.col("line_id") % 5 == 0).alias("held"))
    got_rows = R.item_sums(rated, ~F.col("held"))
    rows = [tuple(r) for r in rated.filter("NOT held").select("user_id", "item_id", "rating").collect()]
    mu, by_item = np.mean([r for _, _, r in rows]), defaultdict(list)
    for _, i, r in rows:
        by_item[i].append(r - mu)
    bi = {i: sum(d) / (len(d) + R.DAMPING) for i, d in by_item.items()}
    left = spark.createDataFrame([(u, i, float(r - mu - bi[i])) for u, i, r in rows], "user_id int, item_id int, rating float")
    want = ALS(userCol="user_id", itemCol="item_id", ratingCol="rating", rank=8, maxIter=6, regParam=0.2, seed=7).fit(left)
    got_mu, items, users = R.residual_factors(got_rows.filter("NOT held"))
    items, users = {r["item_id"]: r for r in items.collect()}, {r["user_id"]: r["p"] for r in users.collect()}
    assert np.isclose(got_mu, mu) and items.keys() == bi.keys() and all(np.isclose(items[i]["bi"], bi[i]) for i in bi)
    plain_items, plain_users = ({r["id"]: r["features"] for r in f.collect()} for f in (want.itemFactors, want.userFactors))
    assert items.keys() == plain_items.keys() and all(np.allclose(items[i]["qi"], plain_items[i], atol=1e-3) for i in items)
    assert users.keys() == plain_users.keys() and all(np.allclose(users[u], plain_users[u], atol=1e-3) for u in users)


def test_diversified_pool(spark, data):
    _, vectors = data
    score = {i: round(float(v @ vectors[0]), 6) for i, v in vectors.items()}
    left, picked = sorted(score, key=lambda i: (-score[i], i))[:120], []
    while left and len(picked) < 30:
        value = [0.72 * score[i] - 0.28 * max((float(vectors[i] @ vectors[j]) for j in picked), default=0.0) for i in left]
        picked.append(left.pop(int(np.argmax(value))))
    assert [r["item_id"] for r in sorted(plan(spark, "mmr_diversify"), key=lambda r: r["rank"])] == picked


def test_a_user_across_batches(spark):
    """Users whose ratings fill several Arrow batches are solved as one."""
    rng = np.random.default_rng(5)
    q = rng.normal(size=(50, 3))
    rated = [(u, int(i), float(r)) for u in range(4) for i, r in zip(rng.integers(0, 50, 30), rng.integers(1, 10, 30), strict=True)]
    items = spark.createDataFrame([(i, [float(a) for a in v], 0.1) for i, v in enumerate(q)], "item_id bigint, qi array<double>, bi double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["user_id"]: r["p"] for r in R.fold_in(spark.createDataFrame(rated, "user_id bigint, item_id bigint, rating double"), items, 3.0, 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for u in range(4):
        x = np.array([q[i] for w, i, _ in rated if w == u])
        y = np.array([r - 3.1 for w, _, r in rated if w == u])
        assert np.allclose(got[u], np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y))


def test_clustering_stops_when_no_row_moves(monkeypatch):
    x, w = np.repeat(np.eye(3), 4, axis=0), np.arange(1.0, 13.0)
    products = []
    monkeypatch.setattr(R.np, "argmax", lambda *a, f=np.argmax, **k: products.append(1) or f(*a, **k))
    centres, near = R.lloyd(x, w, 3, 50)
    first = R.lloyd(x, w, 3, 2)
    assert len(products) < 20 and (near == first[1]).all() and np.array_equal(centres, first[0])
