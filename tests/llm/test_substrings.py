import hashlib
import random
import re

from marlstone.llm import substrings

SCHEMA = "doc_id bigint, text string, kept_text string, addr string"


def brute(rows, window):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            gram = tuple(w[i : i + window])
            first[gram] = min(first.get(gram, rank(d)), rank(d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone |= set(range(i, i + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture(window):
    rng = random.Random(window)
    words = lambda n: [f"{rng.choice('abcdé日')}{rng.randrange(40)}" for _ in range(n)]
    passages = [words(rng.randrange(window - 2, window * 3)) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            parts += words(rng.randrange(0, window)) + rng.choice(passages)
        rows.append((rng.choice([i * 7, 1000 - i]), "\n".join([" ".join(parts), "", " x"])))
    rows += [(5000, " ".join(["same"] * (window * 4))), (5001, " ".join(["same"] * (window * 2))), (1, " ".join(passages[0] * 3)), (None, " ".join(passages[1])), (None, None)]
    return [*rows, (6000, ""), (6001, " \t\n"), (3, rows[4][1]), (3, rows[4][1]), (7000, "long " * 40_000 + " ".join(passages[2]))]


def test_matches_brute_force(spark):
    for window in (50, 7):
        rows = fixture(window)
        for parts in (1, 6):
            docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(parts)
            out = substrings.annotate(docs, window).collect()
            assert sorted((tuple(r) for r in out), key=str) == brute(rows, window)


def test_texts_and_empty(spark):
    rows = fixture(50)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    out = substrings.deduplicated(docs).collect()
    digests = sorted((r["doc_id"] or -1, hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out)
    assert digests == sorted((r[0] or -1, r[3]) for r in brute(rows, 50))
    assert substrings.annotate(docs.limit(0)).collect() == []


def opposites(n=1024):
    """Two long words over a and b, the Thue-Morse sequence and its complement: equal to every polynomial modulo 2 ** 64."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_stay(spark):
    one, other = opposites()
    tail = [f"t{i}" for i in range(49)]
    rows = [(1, " ".join([one, *tail])), (2, " ".join([other, *tail])), (3, " ".join([one, *tail, "x"]))]
    out = substrings.annotate(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 50)
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 0, 2: 0, 3: 50}
