import hashlib
import random

import numpy as np

from marlstone.llm import lines, queries
from tests.llm.test_substrings import opposites

SCHEMA = "doc_id bigint, text string, h string, at string"
WHITE = " \t\n\x0b\x0c\r"


def brute(rows, window=3):
    rank = lambda d: float("inf") if d is None else d
    parsed = []
    for d, t in rows:
        parts = (t or "").split("\n")
        parsed.append((d, parts, [i for i, p in enumerate(parts) if p.strip(WHITE)]))
    first = {}
    for d, parts, units in parsed:
        for k in range(len(units) - window + 1):
            key = tuple(parts[u].strip(WHITE) for u in units[k : k + window])
            first[key] = min(first.get(key, (rank(d), k)), (rank(d), k))
    out = []
    for d, parts, units in parsed:
        gone = set()
        for k in range(len(units) - window + 1):
            key = tuple(parts[u].strip(WHITE) for u in units[k : k + window])
            if first[key] < (rank(d), k):
                gone |= {units[x] for x in range(k, k + window)}
        kept = "\n".join(p for i, p in enumerate(parts) if i not in gone)
        out.append((d, len(units), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(9)
    pool = [f"line {i} é" for i in range(25)]
    rows = []
    for i in range(80):
        body = [rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randrange(0, 14))]
        body = [rng.choice(["", "  ", "\t"]) + x + rng.choice(["", " ", "\r"]) if rng.random() < 0.3 else x for x in body]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body) + 1), " ")
        rows.append((500 - i * 3, "\n".join(body)))
    rows += [(2000, "\n".join(["same"] * 9)), (2001, "\n".join(["same"] * 5)), (2002, None), (2003, ""), (2004, "\n\n"), (None, "\n".join(pool[:5])), (None, "x")]
    return [*rows, (rows[3][0], rows[3][1]), (2005, "\n".join(f"n{i}" for i in range(20_000)) + "\nn5\nn6\nn7")]


def test_matches_brute_force(spark):
    rows = fixture()
    for parts in (1, 5):
        docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(parts)
        assert sorted((tuple(r) for r in lines.annotate(docs).collect()), key=str) == brute(rows)
    out = lines.annotate(docs, gram=1, span=4).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 4)


def test_null_texts_stay_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x", "y"), (2, "a\nb\nc\nd", "x", "y"), (3, "z\na\nb\nc", "x", "y")], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in lines.deduplicated(docs).collect()}
    assert out == {1: None, 2: "a\nb\nc\nd", 3: "z"}
    assert lines.annotate(docs.limit(0)).collect() == []


def test_equal_runs_select_equal_fingerprints():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 9, 300).astype(np.uint64)
    picks = set(lines.selected(hashes, np.zeros(300, dtype=int), 4).tolist())
    assert all(picks & set(range(i, i + 4)) for i in range(297))


def test_single_lines_query_matches_brute_force(spark, tmp_path):
    rows = [*fixture(), (3000, "once\ntwice"), (3001, "once"), (3002, "once\ntwice"), (3003, "new\ntwice\nold")]
    spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op10_single_lines"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 1)
    assert {r["doc_id"]: r["n_removed"] for r in out if (r["doc_id"] or 0) >= 3000} == {3000: 0, 3001: 1, 3002: 2, 3003: 1}


def test_lines_made_to_collide_stay(spark):
    one, other = opposites()
    rows = [(1, f"{one}\nb\nc"), (2, f"{other}\nb\nc"), (3, f"x\n{one}\nb\nc")]
    out = lines.annotate(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 0, 2: 0, 3: 3}


def test_other_texts_under_a_repeated_id(spark):
    for rows in ([(1, "a\nb\nc"), (5, "x1\nx2\nx3\nx4\nx5\na\nb\nc\nz"), (5, "q\nr")], [(1, "a\nb\nc"), (5, "a\nb\nc\nz"), (5, "q\nr\ns\nt")], [(1, "a\nb\nc"), (None, "a\nb\nc\nz"), (None, "q\nr\ns\nt")]):
        out = lines.annotate(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
        assert sorted((tuple(r) for r in out), key=str) == brute(rows)
