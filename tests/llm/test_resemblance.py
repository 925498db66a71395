import random

import numpy as np

import corpus_pipeline
from marlstone.llm import resemblance, simhash

SCHEMA = "doc_id bigint, text string, lang string, th string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The rows that stay: of each component of the similar pairs the smallest id, null last."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    best = {}
    for i, g in enumerate(group):
        best[g] = min(best.get(g, i), i, key=rank)
    return sorted((rows[i] for i in best.values()), key=str)


def fixture():
    rng, rows = random.Random(4), []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randrange(100, 300))]
        for k in range(6):  # similarities on both sides of 0.8
            words = list(base)
            for _ in range(rng.randrange(0, len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 - g * 10 - k, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE\ttwo"), (2004, "one three")]
    return rows


def test_stage_matches_brute_force(spark):
    rows = fixture()
    for parts in (1, 5):
        docs = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], SCHEMA).repartition(parts)
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute(rows)


def test_large_group(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.003 else f"y{i}" for w in base)) for i in range(400)]
    out = resemblance.drop_near_copies(spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == brute(rows)


def test_empty(spark):
    assert resemblance.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_buckets_are_dealt_into_parts(spark):
    """Chains of copies in one bucket, of which the far ends are not alike: parts, pivot and blocks find every link."""
    rng, rows = random.Random(12), fixture()
    words = [f"c{i}" for i in range(260)]
    for k in range(60):
        words[rng.randrange(len(words))] = f"z{k}"
        rows.append((5000 + k, " ".join(words)))
    docs = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA)
    for bucket in (2, 7):
        out = resemblance.drop_near_copies(docs, bucket=bucket).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == brute(rows)
    met = [(1, 8, 1, s, resemblance_set(s)) for s in range(1, 9)]
    sets = spark.createDataFrame([(s, resemblance_set(s)) for s in range(1, 9)], "sid bigint, grams binary")
    links = resemblance.bucket_links(spark.createDataFrame(met, "bucket bigint, n bigint, pivot bigint, sid bigint, grams binary"), sets, bucket=3)
    found = {r["node"]: r["component"] for r in resemblance.components(links).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5} or found == {2: 1, 3: 1, 4: 1, 6: 5, 7: 5}


def resemblance_set(s):
    """1 to 4 are a chain (1-2, 2-3, 3-4 alike, 1-4 not), 5 to 7 are equal but for one value, 8 is alone."""
    first = {1: 0, 2: 8, 3: 16, 4: 24, 5: 1000, 6: 1001, 7: 1002, 8: 5000}[s]
    return np.arange(first, first + 100, dtype=np.uint64).tobytes()


def test_simhash_finds_near_copies_by_itself(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(900)]
        rows += [(k, " ".join(words)), (100 + k, " ".join([*words[:450], "changed", *words[451:]])), (200 + k, " ".join(f"w{rng.randrange(5000)}" for _ in range(50)))]
    rows += [(300, ""), (301, None), (302, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = {i: simhash.fingerprint((t or "").encode(), resemblance.SHINGLE) for i, t in rows}
    near = {100 + k for k in range(12) if (prints[k] ^ prints[100 + k]).bit_count() <= simhash.RADIUS}
    gone = {r["doc_id"] for r in resemblance.near_copies(docs, bands=0).collect()} - {301}
    assert near and near <= gone <= {100 + k for k in range(12)}
