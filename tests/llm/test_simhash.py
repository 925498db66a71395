import random

import numpy as np
import xxhash

from marlstone.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, fp string"


def brute(rows):
    fps = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[doc_id] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    group = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and group[a] < group[b]:
                    group[b], changed = group[a], True
    return {(d, f"{fps[d]:016x}", group[d]) for d in fps}


def fixture_rows():
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((i * 3, " ".join(words)))
    rows += [(500 + i, f"Short {i % 4}") for i in range(8)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "É ß  日本 É ß 日本"), (604, "A" * 100_000), (605, "one two three"), (606, "ONE\x0btwo  three")]
    return [(d, t, "en", "clash") for d, t in rows]


def test_matches_brute_force(spark):
    rows = fixture_rows()
    out = simhash.annotate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out} == brute(rows)
    assert len(out) == len(rows)


def test_large_buckets_take_the_second_family(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(signed, "rep bigint, fp bigint")
    want = {}
    values = sorted(fps)
    for i in range(len(values)):
        want.setdefault(i, i)
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if (values[i] ^ values[j]).bit_count() <= 3 and want[i] < want[j]:
                    want[j], changed = want[i], True
    for bucket in (1024, 5):
        found = {r["node"]: r["component"] for r in simhash.components(simhash.near_links(df, bucket=bucket)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_masks_cover_every_triple():
    masks = simhash.covering_masks(list(range(64)))
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(mask & bits == 0 for mask in masks)


def test_empty_and_null_ids(spark):
    assert simhash.annotate(spark.createDataFrame([], SCHEMA)).collect() == []
    out = simhash.annotate(spark.createDataFrame([(None, "a b c d", "en", "x"), (4, "a b c d", "en", "x"), (4, "a b c d", "en", "x")], SCHEMA)).collect()
    assert [r["component_id"] for r in out] == [4, 4, 4]


def test_one_of_each_component_stays(spark):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute(rows)}


def three_steps():
    """Texts whose fingerprints are at most 3 bits apart from the next one's, the outer two more."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(4000)]
    chain = [list(words)]
    for _ in range(300):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        chain.append(list(words))
    texts = [" ".join(w) for w in chain]
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    apart = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    return next((texts[0], texts[j], texts[k]) for j in range(300) for k in range(j + 1, 301) if apart(0, j) <= 3 and apart(j, k) <= 3 and apart(0, k) > 3)


def test_rows_without_an_id_link_their_neighbours(spark):
    a, b, c = three_steps()
    docs = spark.createDataFrame([(7, a, "en", "x"), (None, b, "en", "x"), (9, c, "en", "x")], SCHEMA)
    assert [r["component_id"] for r in simhash.annotate(docs).collect()] == [7, 7, 7]
    assert [r["doc_id"] for r in simhash.drop_near_copies(docs).collect()] == [7]


def test_another_text_under_a_repeated_id_stays(spark):
    a, b, _ = three_steps()
    other = " ".join(f"other{i}" for i in range(50))
    docs = spark.createDataFrame([(5, other, "en", "x"), (5, b, "en", "x"), (3, a, "en", "x")], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()) == [(3, a), (5, other)]
