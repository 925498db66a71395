"""Fuzzy-name plans against plain Python written from the definitions of their scores."""

import pytest

from marlstone.plans import registry
from marlstone.plans.base import catalog, credits
from marlstone.plans.textual import _ASKED, STOP

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    """Twice the longest common subsequence over both lengths, by the textbook table."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return 2 * row[-1] / (len(a) + len(b))


def window(a, b):
    short, long = sorted((a, b), key=len)
    return max((ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))), default=0.0) if short else 0.0


def token_set(a, b, score):
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([score(first, second), *([score(both, first), score(both, second)] if both else [])])


def weighted(a, b):
    if not a or not b:
        return 0.0
    apart, in_order = max(len(a), len(b)) / min(len(a), len(b)), lambda score: score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if apart < 1.5:
        return max(ratio(a, b), 0.95 * in_order(ratio), 0.95 * token_set(a, b, ratio))
    scale = 0.9 if apart < 8 else 0.6
    return max(ratio(a, b), scale * window(a, b), 0.95 * scale * max(in_order(window), token_set(a, b, window)))


@pytest.fixture(scope="module")
def parts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_brand").collect()]


def plan(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


def test_indel_ratio(spark, parts):
    want = {(q, name): round(ratio(asked, name), 6) for q, asked in enumerate(_ASKED) for name in {p[1] for p in parts}}
    assert {(q, name): s for q, name, s in plan(spark, "indel_ratio")} == want


def test_fuzzy_name(spark, parts):
    want = set()
    for q, asked in enumerate(_ASKED):
        scored = sorted((-round(weighted(asked, t), 6), t) for t in {p[1].lower() for p in parts})
        want |= {(q, t, -s, k) for k, (s, t) in enumerate([x for x in scored if x[0] <= -0.5][:8], 1)}
    assert set(plan(spark, "fuzzy_name")) == want


def test_name_score(spark, parts):
    def score(asked, title):
        base = weighted(asked, title)
        if title == asked:
            return base + 0.5
        if title.startswith(asked):
            return base + 0.15
        content = [w for w in asked.split(" ") if len(w) > 2 and w not in STOP]
        words = sum(w in title.split(" ") for w in content) / len(content) if content else 1.0
        return base * (0.4 + 0.6 * min(1.0, len(title) / max(len(asked), 1))) * (0.2 + 0.8 * words)

    got = {(q, t): s for q, t, s in plan(spark, "name_score")}
    want = {(q, t): score(asked, t) for q, asked in enumerate(_ASKED) for t in {p[1].lower() for p in parts}}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fuzzy_person(spark):
    people = {r["s_suppkey"]: r["s_name"] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    scored = sorted((-round(weighted("Supplier#00000012", n), 6), n, k) for k, n in people.items())
    best = {k: -s for s, _, k in [x for x in scored if x[0] <= -0.75][:15]}
    votes, score = {r["item_id"]: r["votes"] for r in catalog(spark, SF).collect()}, {}
    for r in credits(spark, SF).collect():
        if r["person_id"] in best:
            score[r["item_id"]] = max(score.get(r["item_id"], 0), best[r["person_id"]])
    want = sorted((-s, -votes[i], i) for i, s in score.items())[:50]
    assert [(r["item_id"], r["score"]) for r in registry.QUERIES["fuzzy_person"](spark, SF).collect()] == [(i, -s) for s, _, i in want]


def test_fuzzy_keyword(spark, parts):
    scored = sorted((-round(weighted("Brand#1", b), 6), b) for b in {p[2] for p in parts})
    best = {b: -s for s, b in [x for x in scored if x[0] <= -0.8][:15]}
    assert dict(plan(spark, "fuzzy_keyword")) == {k: best[b] for k, _, b in parts if b in best}
