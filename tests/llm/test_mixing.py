import hashlib
import math
import re
from collections import defaultdict

from marlstone.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, taken string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(d, s, t, "q", "r") for d, s, t in rows], SCHEMA)


def rows_of():
    rows = [(i, f"s{i % 5}", "w " * (i % 17 + 1)) for i in range(400)]
    rows += [(1000 + i, None, "n " * 3) for i in range(4)] + [(2000 + i, "é", None) for i in range(3)] + [(None, "s0", "a b"), (1, "s1", "w  w"), (5000, "big", "b " * 50_000)]
    return rows


def test_targets_and_taken(spark):
    out = mixing.mix(frame(spark, rows_of())).collect()
    assert len(out) == len(rows_of())
    total = sum(r["size"] for r in out)
    source_of = {(d, len((t or "").split())): s for d, s, t in rows_of()}
    by = defaultdict(list)
    for r in out:
        by[(source_of[r["doc_id"], r["size"]], r["source_size"], r["target"])].append(r)
    for (_, size, target), group in by.items():
        assert target <= 3 * size + 1e-9
        assert sum(r["taken"] for r in group) <= target + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in group)
        assert all(0 <= r["position"] <= 1 for r in group if r["taken"])
        assert sum(r["taken"] for r in group) > target - 1
    assert abs(sum(t for _, _, t in by) - total) < 1e-6 * total


def brute_targets(sizes, weights=(1, 2, 3)):
    w = {k: weights[i % 3] for i, k in enumerate(sorted(sizes))}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[k] for k in capped)) / max(1, sum(w[k] for k in sizes if k not in capped))
        over = {k for k in sizes if k not in capped and level * w[k] > 3 * sizes[k]}
        if not over:
            return {k: 3 * sizes[k] if k in capped else level * w[k] for k in sizes}
        capped |= over


def test_targets_match_iteration(spark):
    sizes = {"0a": 10, "0b": 1000, "0c": 3, "0d": 77, "0e": 0, "1": 40}
    out = mixing.targets(spark.createDataFrame(list(sizes.items()), "skey string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert all(abs(r["target"] - want[r["skey"]]) < 1e-6 for r in out)


def test_reruns_agree_and_order(spark):
    df = frame(spark, rows_of())
    a, b = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    positions = [r["mix_position"] for r in mixing.mixed_documents(df).collect()]
    assert positions == sorted(positions) and positions


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    out = mixing.mix(frame(spark, [(1, "a", None), (2, None, "")])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in out)


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_places(rows, cap=3):
    """Every copy that the mix takes, (doc_id, source, text, copy, taken, position), word by word from the definition."""
    key = lambda s: "1" if s is None else "0" + s
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[key(s)] += words_of(t)
    goal, slopes = brute_targets(sizes), {k: (0.5, 0.0, -0.5)[i % 3] for i, k in enumerate(sorted(sizes))}
    order = lambda r: hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}:{hashlib.md5((r[2] or '').encode()).hexdigest()}".encode()).hexdigest()
    out = []
    for k in sizes:
        at = 0
        for copy in range(1, cap + 1):
            for d, s, t in sorted((r for r in rows if key(r[1]) == k), key=order):
                taken = max(0, min(words_of(t), math.floor(goal[k]) - at))
                if taken:
                    low, high, a = 0.0, 1.0, slopes[k]
                    for _ in range(60):  # the demand goal * (t + a (t * t - t)) rises with t
                        mid = (low + high) / 2
                        low, high = (mid, high) if goal[k] * (mid + a * (mid * mid - mid)) < at else (low, mid)
                    out.append((d, s, t, copy, taken, high))
                at += words_of(t)
    return out


def test_every_copy_has_its_own_place(spark):
    rows = [*rows_of(), (7, "s2", "other text"), (7, "s2", "other text"), (None, "s0", "c d e"), (None, "s0", "c d e")]
    docs = spark.createDataFrame([(d, s, t, "q", 5) for d, s, t in rows], "doc_id bigint, source string, text string, mix_taken string, mix_copy int")
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "source", "text", "mix_copy", "mix_taken", "mix_position"]
    got = [tuple(r) for r in out.collect()]
    assert [r[5] for r in got] == sorted(r[5] for r in got) and max(r[3] for r in got) == 3
    want = brute_places(rows)
    plain = lambda x: sorted((str(r[:5]), round(r[5], 9)) for r in x)
    a, b = plain(got), plain(want)
    assert [k for k, _ in a] == [k for k, _ in b] and all(abs(x - y) < 1e-7 for (_, x), (_, y) in zip(a, b, strict=True))
    per_source = defaultdict(int)
    for r in got:
        per_source[r[1]] += r[4]
    assert sum(per_source.values()) <= sum(words_of(t) for _, _, t in rows)


def test_more_buckets_give_the_same_mix(spark):
    df = frame(spark, rows_of())
    before, kept = mixing.mix(df).collect(), mixing.BUCKET_ROWS
    mixing.BUCKET_ROWS = 0.05
    try:
        after = mixing.mix(df).collect()
    finally:
        mixing.BUCKET_ROWS = kept
    assert sorted(map(str, before)) == sorted(map(str, after))


def test_documents_with_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b c", "x", 9, "p"), (1, "d e f g", "x", 9, "p"), (2, "h", None, 9, "p"), (None, "i j", "x", 9, "p"), (3, None, "y", 9, "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_taken int, position string")
    first = mixing.mixed_documents(docs)
    assert first.columns == ["doc_id", "text", "source", "position", "mix_copy", "mix_taken", "mix_position"]
    again = mixing.mixed_documents(docs.orderBy("text"))
    key = lambda r: (r["doc_id"] or 0, r["text"], r["mix_copy"])
    assert sorted(first.collect(), key=key) == sorted(again.collect(), key=key)
    assert {r["doc_id"] for r in first.collect()} <= {1, 2, None}
